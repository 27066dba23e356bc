"""Languages of notebooks and of each stretch of their prose: a linear-chain conditional random field over words.

Prose is what a notebook's markdown cells say, without code, formulas, links and images. Its words are labelled by a
CRF: a word's affixes, character n-grams, script and membership in word lists vote for a language, learned transitions
(one table within a sentence, one across its end) tie neighbours together, and forward-backward gives each
word a probability per language. The model is fitted on a bounded sample of notebooks with a label, whose labels may
be wrong or mixed: their sentences are first relabelled by clustering around the labels.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Frequent short words, as a start for corpora with few labels; the rest is learned. Languages not listed have none.
WORDS = {
    "en": "the of and to is that this with for was not are you it have",
    "de": "der die und das ist nicht mit den wir von ein auf für sich",
    "fr": "le la les des et est dans pour que une nous sur du pas vous",
    "es": "el los las y en es por con una para del que se no su",
    "pt": "o os as e em um uma não com para do da que mais é",
    "it": "il di che è per una non con della sono gli alla più lo nel",
    "nl": "de het een van en niet dat met voor zijn we op te wordt er",
    "sv": "och att det som en är på för inte vi med den av till har",
    "pl": "nie się na jest że do to w z co jak ale przez tak od",
    "ru": "и не на что это как мы для по все он из но то",
    "ja": "の に は を が です ます した から",
}
#: Other codes of the same languages: ISO 639-2 terminology and bibliography codes.
CODES = {
    "en": "eng", "de": "deu ger", "fr": "fra fre", "es": "spa", "pt": "por", "it": "ita", "nl": "nld dut", "sv": "swe", "pl": "pol", "ru": "rus", "ja": "jpn",
}

BUCKETS = 1 << 15
WINDOW = 192  # words of a sequence that the model is fitted on
COUNTS_FROM = 0.2
#: More languages than there are codes of two or three letters in use are an error.
MAX_LANGUAGES = 1000
KNOWN_WORDS = 200_000

_MARKUP = re.compile(
    r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)"  # fenced code
    r"|\$\$.*?\$\$|\\\[.*?\\\]|\\\(.*?\\\)|\$[^\s$](?:[^$\n]*[^\s$])?\$"  # formulas
    r"|(`+)(?!`).*?(?<!`)\1(?!`)"  # code spans
    r"|!?\[[^\[\]]*\](?:\([^()\s]*(?:\([^()]*\)[^()\s]*)*(?:\s+[^()\n]*)?\)|\[[^\[\]\n]*\])"  # images and links
    r"|^[ ]{0,3}\[[^\]\n]+\]:[ \t]*\S+.*?$"  # link definitions
    r"|<!--.*?-->|</?[A-Za-z][^<>\n]*>|<[a-z]+:[^<>\s]*>"  # markup and autolinks
    r"|\b(?:https?|ftp)://\S+|\bdata:[\w/+.-]+;base64,\S*|&\#?\w+;",
    re.S | re.M,
)
_CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ"
_MARK = "̀-゙゚ͯ"
_WORD = re.compile(rf"[{_CJK}][{_CJK}{_MARK}]{{0,3}}|(?:[^\W\d_{_CJK}][{_MARK}]*)+|[.!?。！？…]+(?=\s|\Z|[{_CJK}])|[\r\n]+")


def blank_markup(body: str) -> str:
    """The body with blanks in place of all that is no prose; places stay the same."""
    return _MARKUP.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), body)


def words_of(body: str) -> tuple[list[str], list[int], list[int], list[bool]]:
    """Words, their places, the characters each stands for (up to the next word or the line's end), and whether a sentence begins there."""
    text = blank_markup(body)
    words, starts, ends, begins = [], [], [], []
    new, last = True, 0
    for m in _WORD.finditer(text):
        w = m.group()
        c = w[0]
        if c in "\r\n":
            new = True
            if len(ends) > last:
                ends[-1] = m.start()
                last = len(ends)
        elif c in ".!?。！？…":
            new = True
        else:
            if len(ends) > last:
                ends[-1] = m.start()
            words.append(w)
            starts.append(m.start())
            ends.append(m.end())
            begins.append(new)
            new = False
    return words, starts, ends, begins


def normal(word: str) -> str:
    return unicodedata.normalize("NFC", word).lower()


def _script(c: str) -> str:
    o = ord(c)
    if 0x3040 <= o <= 0x30FF or 0xFF66 <= o <= 0xFF9F:
        return "kana"
    if 0x400 <= o <= 0x52F:
        return "cyr"
    if o < 0x250:
        return "lat"
    return "han" if 0x3400 <= o <= 0x9FFF else "other"


_LISTED: dict[str, list[str]] = {}
for _code, _list in WORDS.items():
    for _w in _list.split():
        _LISTED.setdefault(_w, []).append(_code)


def features(word: str) -> np.ndarray:
    """Hashed features of a normalised word: itself, affixes, n-grams, script, word lists, and its letters without accents."""
    bare = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
    bare = bare.replace("ae", "a").replace("oe", "o").replace("ue", "u")  # umlauts are spelt either way
    w = f"^{word[:40]}$"
    out = [f"w{word}", f"b{bare}", f"s{_script(word[0])}", f"l{min(len(word), 12)}"]
    out += [f"p{word[:n]}" for n in (1, 2, 3)] + [f"e{word[-n:]}" for n in (1, 2, 3, 4)]
    out += [f"n{w[i : i + n]}" for n in (2, 3) for i in range(len(w) - n + 1)]
    out += [f"x{c}" for c in word if ord(c) > 127]
    out += [f"L{c}" for c in _LISTED.get(word, ())]
    return np.unique(np.array([zlib.crc32(f.encode("utf-8", "surrogatepass")) % BUCKETS for f in out], np.int64))


class Vocabulary:
    """Word to row of emission scores; each word is scored once."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.row, self.scores = weights, {}, np.zeros((1024, weights.shape[1]), np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self.row) > KNOWN_WORDS:
            self.row.clear()
        row = self.row
        for w in words:
            if w not in row:
                n = len(row)
                if n >= len(self.scores):
                    self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
                self.scores[n] = self.weights[features(normal(w))].sum(0)
                row[w] = n
        return np.fromiter(map(row.__getitem__, words), np.int64, len(words))


def marginals(emit: np.ndarray, begins: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over sequences laid end to end.

    Returns each word's label probabilities, the expected transitions (2 x L x L: within and across sentences), and the
    log likelihood of the evidence. Sequences are run side by side, longest first; each step scales to one.
    """
    n, k = emit.shape
    if not n:
        return emit.copy(), np.zeros_like(transitions), 0.0
    top = emit.max(1, keepdims=True)
    e = np.exp(emit - top).astype(np.float64)
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    long = lengths[order]
    steps = int(long[0])
    active = np.searchsorted(-long, -np.arange(steps), "left")  # sequences longer than t
    trans = np.exp(transitions)
    alpha, beta, scale = np.empty((n, k)), np.empty((n, k)), np.empty(n)
    expected = np.zeros_like(trans)
    a = e[first] * np.exp(start)
    for t in range(steps):
        m = active[t]
        at = first[:m] + t
        if t:
            b = begins[at][:, None]
            a = np.where(b, a[:m] @ trans[1], a[:m] @ trans[0]) * e[at]
        c = a.sum(1)
        a = a / c[:, None]
        alpha[at], scale[at] = a, c
    back = np.ones((active[-1] if steps else 0, k))
    for t in range(steps - 1, -1, -1):
        m = active[t]
        at = first[:m] + t
        now = np.ones((m, k))
        if t + 1 < steps:
            after = active[t + 1]
            nxt = first[:after] + t + 1
            b = begins[nxt]
            right = back[:after] * e[nxt] / scale[nxt][:, None]
            now[:after] = np.where(b[:, None], right @ trans[1].T, right @ trans[0].T)
            left = alpha[first[:after] + t]
            expected[1] += left[b].T @ right[b]
            expected[0] += left[~b].T @ right[~b]
        back = now
        beta[at] = now
    p = alpha * beta
    p /= p.sum(1, keepdims=True)
    return p, expected * trans, float(np.log(scale).sum() + top.sum())


@dataclass
class Model:
    codes: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray


def _relabel(words: np.ndarray, sentence: np.ndarray, given: np.ndarray, feats: list[np.ndarray], k: int, listed: np.ndarray) -> np.ndarray:
    """Label of each sentence: naive Bayes around the notebooks' labels, repeated without the labels' full weight."""
    n_sent = int(sentence.max()) + 1
    flat = np.concatenate(feats)
    size = np.array([len(f) for f in feats])
    offs = np.cumsum(size) - size
    lists = np.zeros((n_sent, k))
    np.add.at(lists, sentence, listed[words])
    prior = np.zeros((n_sent, k))
    prior[np.arange(n_sent), given] = 3.0
    q = prior + lists * 1.5
    for _ in range(4):
        q = np.exp(q - q.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        per_word = np.zeros((len(feats), k))
        np.add.at(per_word, words, q[sentence])
        counts = np.full((BUCKETS, k), 0.02)
        np.add.at(counts, flat, np.repeat(per_word, size, axis=0))
        log = np.log(counts / counts.sum(0))
        score = np.add.reduceat(log[flat], offs, axis=0) / np.sqrt(size)[:, None]
        q = prior + lists
        np.add.at(q, sentence, score[words])
    return q.argmax(1)


def fit(texts: list[list[str]], labels: list[str], codes: list[str], passes: int = 40, rate: float = 0.25, decay: float = 2e-3) -> Model:
    """Fit the CRF by maximum likelihood (Adam over the whole sample). ``texts``: prose bodies of each sampled notebook."""
    k, index = len(codes), {c: i for i, c in enumerate(codes)}
    vocab: dict[str, int] = {}
    words, sentence, given, begins, lengths = [], [], [], [], []
    n_sent = 0
    for bodies, label in zip(texts, labels):
        n = 0
        for body in bodies:
            ws, _, _, bs = words_of(body)
            for w, b in zip(ws, bs):
                if b:
                    n_sent += 1
                    given.append(index[label])
                words.append(vocab.setdefault(normal(w), len(vocab)))
                sentence.append(n_sent - 1)
                begins.append(b)
            n += len(ws)
        while n > 0:  # long notebooks train in parts
            lengths.append(min(n, WINDOW))
            n -= WINDOW
    listed = np.zeros((len(vocab), k))
    for w, i in vocab.items():
        for c in _LISTED.get(w, ()):
            if c in index:
                listed[i, index[c]] = 1.0 / len(_LISTED[w])
        sure = {"kana": "ja", "cyr": "ru"}.get(_script(w[0]))
        if sure in index:
            listed[i, index[sure]] += 1.0
    weights = np.zeros((BUCKETS, k))
    if not words:
        for code in codes:
            for w in WORDS.get(code, "").split():
                weights[zlib.crc32(f"L{code}".encode()) % BUCKETS, index[code]] = 4.0
        return Model(codes, weights.astype(np.float32), np.eye(k)[None].repeat(2, 0) * np.array([4.0, 1.0])[:, None, None], np.zeros(k))
    feats = [features(w) for w in vocab]
    word, sent, begin, length = np.array(words), np.array(sentence), np.array(begins), np.array(lengths)
    gold = _relabel(word, sent, np.array(given), feats, k, listed)[sent]

    flat, size = np.concatenate(feats), np.array([len(f) for f in feats])
    offs = np.cumsum(size) - size
    used, dense = np.unique(flat, return_inverse=True)
    by_feature = np.argsort(dense, kind="stable")
    feature_at = np.searchsorted(dense[by_feature], np.arange(len(used)))
    of_entry = np.repeat(np.arange(len(feats)), size)[by_feature]
    by_word = np.argsort(word, kind="stable")
    word_at = np.searchsorted(word[by_word], np.arange(len(feats)))
    starts = np.cumsum(length) - length
    inner = np.ones(len(word), bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, k, k))
    np.add.at(seen, (begin[at].astype(int), gold[at - 1], gold[at]), 1)
    first = np.bincount(gold[starts], minlength=k)

    w, trans, start = np.zeros((len(used), k)), np.stack([np.eye(k) * 2, np.eye(k)]), np.zeros(k)
    params = [w, trans, start]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    hot = np.zeros((len(word), k))
    hot[np.arange(len(word)), gold] = 1
    scale = 1 / len(word)
    for step in range(1, passes + 1):
        emit = np.add.reduceat(w[dense], offs, axis=0)
        p, expected, _ = marginals(emit[word], begin, length, trans, start)
        per_word = np.add.reduceat((p - hot)[by_word], word_at, axis=0)
        grads = [
            np.add.reduceat(per_word[of_entry], feature_at, axis=0) * scale + decay * w / len(used),
            (expected - seen) * scale + 1e-4 * trans,
            (p[starts].sum(0) - first) * scale,
        ]
        for x, g, a, b in zip(params, grads, m1, m2):
            a += 0.1 * (g - a)
            b += 0.02 * (g * g - b)
            x -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.98**step)) + 1e-8)
    weights[used] = w
    return Model(codes, weights.astype(np.float32), trans, start)


def label_words(model: Model, vocab: Vocabulary, rows: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Label probabilities of every word, by forward-backward over each whole notebook: what lies beside it in the batch has no part in it."""
    return marginals(vocab.scores[rows], begins, lengths[lengths > 0], model.transitions, model.start)[0]


def markdown_bodies(text: str | None, kinds: list, froms: list, tos: list) -> list[tuple[int, str]]:
    """(place, body) of the markdown cells; places out of bounds or null are held against the text."""
    if not text:
        return []
    n = len(text)
    out = []
    for kind, a, b in zip(kinds, froms, tos):
        if kind == "markdown":
            a, b = max(0, a or 0), n if b is None else min(n, b)
            if a < b:
                out.append((a, text[a:b]))
    return out


def _cells(b: pa.RecordBatch, name: str):
    cells = b.column(name)
    o = cells.offsets.to_pylist()
    flat = cells.values
    kinds, froms, tos = (flat.field(f).to_pylist() for f in ("cell_type", "char_from", "char_to"))
    valid = cells.is_valid().to_pylist()
    for i in range(len(b)):
        lo, hi = (o[i], o[i + 1]) if valid[i] else (0, 0)
        yield kinds[lo:hi], froms[lo:hi], tos[lo:hi]


_SEGMENT = "struct<char_from:int,char_to:int,lang:string,confidence:double>"
_SHARE = "struct<lang:string,share:double,confidence:double>"


def _labeller(held, stretches: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        vocab = Vocabulary(model.weights)
        k = len(model.codes)
        codes = np.array(model.codes, object)
        for batch in batches:
            for b in (batch.slice(i, 500) for i in range(0, len(batch), 500)):
                words, begins, lengths, starts, ends = [], [], [], [], []
                for text, cells in zip(b.column("text").to_pylist(), _cells(b, "cells")):
                    n = 0
                    for place, body in markdown_bodies(text, *cells):
                        ws, ss, es, bs = words_of(body)
                        words += ws
                        begins += bs
                        starts += [place + s for s in ss]
                        ends += [place + e for e in es]
                        n += len(ws)
                    lengths.append(n)
                length = np.array(lengths, np.int64)
                start, end = np.array(starts, np.int64), np.array(ends, np.int64)
                p = label_words(model, vocab, vocab.rows(words), np.array(begins, bool), length) if words else np.zeros((0, k))
                best = p.argmax(1) if len(p) else np.zeros(0, np.int64)
                sure = p[np.arange(len(p)), best] if len(p) else np.zeros(0)
                doc = np.repeat(np.arange(len(b)), length)
                chars = (end - start).astype(float)
                sums = np.bincount(doc * k + best, chars, len(b) * k).reshape(len(b), k)
                conf = np.bincount(doc * k + best, chars * sure, len(b) * k).reshape(len(b), k)
                total = np.maximum(sums.sum(1, keepdims=True), 1e-9)
                shares = [[{"lang": codes[j], "share": float(sums[i, j] / total[i, 0]), "confidence": float(conf[i, j] / sums[i, j])} for j in np.argsort(-sums[i], kind="stable") if sums[i, j] > 0] for i in range(len(b))]
                segments: list[list[dict]] = [[] for _ in range(len(b))]
                if stretches and len(best):
                    cut = np.ones(len(best), bool)
                    cut[1:] = (best[1:] != best[:-1]) | (doc[1:] != doc[:-1])
                    at = np.flatnonzero(cut)
                    weight = np.add.reduceat(chars, at)
                    mean = np.add.reduceat(chars * sure, at) / np.maximum(weight, 1e-9)
                    stop = np.append(at[1:], len(best)) - 1
                    for i, z, c in zip(at.tolist(), stop.tolist(), mean.tolist()):
                        segments[doc[i]].append({"char_from": int(start[i]), "char_to": int(end[z]), "lang": codes[best[i]], "confidence": c})
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("lang"), pa.array(shares, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64()), ("confidence", pa.float64())]))),
                     pa.array(segments, pa.list_(pa.struct([("char_from", pa.int32()), ("char_to", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())])))],
                    names=["doc_id", "label", "langs", "stretches"],
                )

    return run


def label_resolver(languages: list[tuple[str, str | None, str | None]]):
    """A function from a label in any notation to a code, or None if it names no known language.

    Codes of two or three letters, English and own names with or without accents, any case and blanks, and with a
    region, script or encoding after them.
    """
    bare = lambda s: "".join(c for c in unicodedata.normalize("NFD", s.strip().lower()) if not unicodedata.combining(c))
    known: dict[str, str] = {}
    for code, english, own in languages:
        for name in (code, english, own, *CODES.get(code, "").split()):
            if name:
                known.setdefault(bare(name), code)

    def resolve(label: str | None) -> str | None:
        if label is None:
            return None
        text = bare(label)
        if text in known:
            return known[text]
        parts = re.findall(r"[^\W\d_]+", text)
        if parts and parts[0] in known:
            return known[parts[0]]
        named = {known[p] for p in parts if len(p) > 3 and p in known}
        return named.pop() if len(named) == 1 else None

    return resolve


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [[body for _, body in markdown_bodies(t, *c)] for t, c in zip(b.column("text").to_pylist(), _cells(b, "cells"))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("code"), pa.array(out, pa.list_(pa.string()))], names=["doc_id", "code", "bodies"])


def train(docs: DataFrame, languages: list[tuple[str, str | None, str | None]], per_label: int = 80, seed: int = 5) -> Model:
    """Fit on at most ``per_label`` whole notebooks of each label, drawn by a hash of doc_id: the sample's bound is per_label x languages."""
    resolve = label_resolver(languages)
    code = F.pandas_udf(lambda s: s.map(resolve, na_action=None), T.StringType())
    labels = docs.where(F.col("lang").isNotNull() & (F.size("cells") > 0)).select("doc_id", code("lang").alias("code")).where("code is not null")
    draw = F.row_number().over(Window.partitionBy("code").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id"))
    drawn = labels.withColumn("draw", draw).where(F.col("draw") <= per_label).select("doc_id", "code")
    sample = docs.select("doc_id", "text", "cells").join(F.broadcast(drawn), "doc_id").select("doc_id", "code", "text", "cells")
    rows = sample.mapInArrow(_bodies, "doc_id bigint, code string, bodies array<string>").collect()
    rows.sort(key=lambda r: (r.doc_id, r.code, r.bodies))
    return fit([r.bodies for r in rows], [r.code for r in rows], [c for c, *_ in languages])


def label_languages(docs: DataFrame, languages: DataFrame, *, per_label: int = 80, stretches: bool = True, model: Model | None = None) -> DataFrame:
    """(doc_id, label, label_code, langs, stretches) for every row of ``docs`` (doc_id, text, lang, cells).

    langs lists (lang, share of the prose's characters, confidence) by falling share, stretches the (char_from, char_to, lang,
    confidence) of each run of words of one language, in code points of the text. Null or empty texts, and those
    without prose, get empty lists. Texts of any length are read whole. Repeated rows are labelled alike.
    languages: (code, english_name, own_name), at most MAX_LANGUAGES rows. An empty table of documents gives no rows.
    """
    known = [(r.code, r.english_name, r.own_name) for r in languages.orderBy("code").limit(MAX_LANGUAGES + 1).collect()]
    if len(known) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: the field's transitions are a table of all pairs of them")
    resolve = label_resolver(known)
    code = F.pandas_udf(lambda s: s.map(resolve, na_action=None), T.StringType())
    docs = docs.select("doc_id", "lang", "text", "cells")
    held = docs.sparkSession.sparkContext.broadcast(model or train(docs, known, per_label))
    out = docs.mapInArrow(_labeller(held, stretches), f"doc_id bigint, label string, langs array<{_SHARE}>, stretches array<{_SEGMENT}>")
    return out.select("doc_id", "label", code("label").alias("label_code"), "langs", "stretches")


def wrong_or_missing(labelled: DataFrame, least: float = COUNTS_FROM) -> DataFrame:
    """(doc_id, lang, share, confidence): the languages that count of each notebook whose label is missing or wrong or whose prose is mixed."""
    count = labelled.withColumn("langs", F.filter("langs", lambda x: x["share"] >= least)).where(F.size("langs") > 0)
    case = F.col("label_code").isNull() | (F.size("langs") > 1) | (F.get("langs", F.lit(0))["lang"] != F.col("label_code"))
    return count.where(case).select("doc_id", F.explode("langs").alias("l")).select("doc_id", "l.lang", "l.share", "l.confidence")
