"""Language identification by word scores and a Viterbi path.

Learning: character n-gram counts (1 to 3 characters of each lower-case word
with its borders, hashed) for each language, from a bounded sample of labelled
rows.  The sample takes rows whose hashed id lies under a threshold set from the
number of rows of each language, so it is the same on every run and its size
does not grow with the input (``SAMPLE`` documents a language, about).

Prediction: each word gets a log probability in each language.  The scripts of a
word's letters narrow its candidates to languages that were seen in them.  The
Viterbi path over a document's words pays ``SWITCH`` for each change of language,
which labels spans of mixed text; the language with the most letters on the path
is the document's, and ``score`` is its share of the letters times the logistic
of the margin, which is one half or more.  The score is 0 where the text is in
no learned language: words in scripts of none have more letters than the main
language, or the likelihood per letter on the path lies ``FAR`` nats and
``FAR_SHORT`` over the root of the number of letters below that of the sample.

Memory holds for any number of languages: the path is read back from one label and
one bit set a word, scores are kept for fewer words the more languages there are,
and spans grow so that their tables stay within ``SPAN_CELLS``.

Defined cases: null texts and texts without a letter are ``und`` with score 0.
Equal texts get equal results, so repeated rows too.  Without any labelled row all
is ``und``.  A null id is not held out and nothing is learned from its row.  Texts
of any length are labelled whole.  Other columns are ignored (``keep`` returns
them), whatever their names; an empty table has no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import vec
from plumbline.llm.bpe import text_slices

#: Labelled documents for each language in the sample (expected number).
SAMPLE = 1500
BUCKETS, SWITCH = 1 << 16, 12.0
#: Most by which a word can favour one language over another.
MOST = 10.0
#: Nats per letter below the learned sample from which a text is in no learned language; more for short texts.
FAR, FAR_SHORT = 8.0, 12.0
#: Most entries of the span tables of one call, and most of the scores kept by a worker.
SPAN_CELLS, SCORE_CELLS = 4_000_000, 4_000_000
_CHUNK = re.compile(r"\S+")
_NO_WORD = re.compile(r"[\d@/\\]")
#: First code point of each script range, in order; fixed values.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
)
_EDGES = np.array([a for a, _ in SCRIPTS])
_NAMES = sorted({s for _, s in SCRIPTS})
_OF_EDGE = np.array([_NAMES.index(s) for _, s in SCRIPTS])
_LATIN = _NAMES.index("latin")


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the n-grams of non-empty lower-case words.

    The words stand in one array of code points with one border between them, so
    position p begins one n-gram of each length.  Gives buckets (3 x positions), the
    mask of real n-grams (letters alone; no triple over a border), the first
    position of each word (its left border), and the code points.
    """
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    one, two, three = codes[:-1], codes[1:], np.append(codes[2:], np.uint64(32))
    keys = np.stack([one, one | two << np.uint64(21), one | two << np.uint64(21) | three << np.uint64(42)])
    keys += np.array([[1], [2], [3]], np.uint64) << np.uint64(60)
    border = codes == 32
    real = np.stack([~border[:-1], np.ones(len(one), bool), ~border[1:]])
    return (vec.mix(keys) % np.uint64(BUCKETS)).astype(np.int64), real, np.flatnonzero(border[:-1]), codes


def letters(chunk: str) -> str:
    """The letters of a chunk in lower case; none of keys, numbers and addresses.

    Those are written in Latin letters: in a chunk with a digit, letters of other
    scripts count, as a whole sentence may stand without a space.
    """
    if chunk.isalpha():
        return chunk.lower()
    if _NO_WORD.search(chunk):
        return "" if chunk.isascii() else "".join([c for c in chunk if c >= "\u0370" and c.isalpha()]).lower()
    return "".join([c for c in chunk if c.isalpha()]).lower()


def script_bits(word: str) -> int:
    """A bit for the script of most of a word's letters."""
    codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4")
    found = np.bincount(_OF_EDGE[np.searchsorted(_EDGES, codes, side="right") - 1], minlength=len(_NAMES))
    return 1 << int(found.argmax())


def scripts_of(words: list[str], codes: np.ndarray) -> np.ndarray:
    """Script bits of each word; all Latin at once where no other letter occurs."""
    if codes.max(initial=0) < 0x370:
        return np.full(len(words), 1 << _LATIN, np.int64)
    return np.array([1 << _LATIN if w.isascii() else script_bits(w) for w in words], np.int64)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # bucket x language, log probabilities
    scripts: np.ndarray  # language -> bits of scripts
    usual: np.ndarray  # language -> log probability per letter in the sample
    known: dict = field(default_factory=dict)  # chunk of text -> row
    words: dict = field(default_factory=dict)  # its letters -> row
    scores: np.ndarray | None = None
    weights: np.ndarray | None = None  # letters of each row
    strange: np.ndarray | None = None  # rows in scripts of no language

    def rows(self, chunks: list[list[str]]) -> np.ndarray:
        """Row of each chunk in ``scores`` and ``weights``; new words are scored.

        Row 0 is for chunks without a letter.
        """
        if len(self.known) > SCORE_CELLS // max(16, len(self.langs)) or self.scores is None:
            self.known, self.words = {}, {"": 0}
            self.scores, self.weights = np.zeros((1, len(self.langs)), np.float32), np.zeros(1, np.int32)
            self.strange = np.zeros(1, bool)
        new = list(set().union(*chunks).difference(self.known))
        if new:
            plain = list(map(letters, new))
            fresh = list(set(plain).difference(self.words))
            if fresh:
                self.words.update(zip(fresh, range(len(self.scores), len(self.scores) + len(fresh))))
                bucket, real, first, codes = grams(fresh)
                each = self.table[bucket[0]] * real[0][:, None] + self.table[bucket[1]] + self.table[bucket[2]] * real[2][:, None]
                made = np.add.reduceat(each, first, axis=0)
                allowed = (scripts_of(fresh, codes)[:, None] & self.scripts[None, :]) != 0
                made[(~allowed) & allowed.any(1)[:, None]] -= 40.0
                made = np.maximum(made, made.max(axis=1, keepdims=True) - MOST)
                self.scores = np.concatenate([self.scores, made.astype(np.float32)])
                self.strange = np.concatenate([self.strange, ~allowed.any(1)])
                self.weights = np.concatenate([self.weights, np.fromiter(map(len, fresh), np.int32, len(fresh))])
            self.known.update(zip(new, map(self.words.__getitem__, plain)))
        get = self.known.__getitem__
        return np.concatenate([np.fromiter(map(get, x), np.int64, len(x)) for x in chunks]) if chunks else np.zeros(0, np.int64)

    def predict(self, texts: list[str]) -> list[tuple[str, float, int]]:
        """(language, score, number of spans) of each text."""
        return [(lang, score, len(runs)) for lang, score, runs in self._labels(texts)[0]]

    def label(self, texts: list[str]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """(language, score, spans) of each text, a span being (start, end, language).

        Offsets are code points, the end exclusive.  A span reaches from its first
        word or other chunk to its last, so only white space is in none.
        """
        out, again = self._labels(texts)
        for i, (lang, score, runs) in enumerate(out):
            t = texts[i]
            if len(runs) == 1 and i not in again:
                spans = [(len(t) - len(t.lstrip()), len(t.rstrip()), runs[0][2])]
            elif runs:
                at = [m.span() for m in _CHUNK.finditer(t) if i not in again or any(map(str.isalpha, m.group()))]
                spans = [(at[a][0], at[b - 1][1], k) for a, b, k in runs]
            else:
                spans = []
            out[i] = lang, score, spans
        return out

    def _labels(self, texts: list[str]) -> tuple[list[tuple[str, float, list[tuple[int, int, str]]]], set[int]]:
        """What _predict gives, and which texts were judged by the letters of all chunks that have one."""
        out, again = self._predict(texts), set()
        # Texts whose only letters stand in keys, numbers and addresses are judged by those.
        for i, (lang, *_) in enumerate(out):
            if lang == "und" and self.langs and any(map(str.isalpha, texts[i])):
                plain = ["".join(filter(str.isalpha, c)) for c in texts[i].split()]
                out[i] = self._predict([" ".join(plain)])[0]
                again.add(i)
        return out, again

    def _predict(self, texts: list[str]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """(language, score, runs) of each text, a run being (first chunk, chunk after the last, language)."""
        if not self.langs or not texts:
            return [("und", 0.0, [])] * len(texts)
        chunks = [t.split() for t in texts]
        row = self.rows(chunks)
        size = np.array([len(c) for c in chunks], np.int64)
        path, _ = viterbi(self.scores, row, size, SWITCH)
        doc, n, c = np.repeat(np.arange(len(texts)), size), len(texts), len(self.langs)
        known = self.weights[row] * ~self.strange[row]
        total = np.bincount(doc, weights=self.weights[row], minlength=n)
        mass = np.bincount(doc * c + path, weights=known, minlength=n * c).reshape(n, c)
        got = np.bincount(doc, weights=self.scores[row, path] * ~self.strange[row], minlength=n)
        gain = np.stack([np.bincount(doc, weights=self.scores[row, k], minlength=n) for k in range(c)], axis=1)
        best, at = mass.argmax(1), np.arange(n)
        others = gain.astype(np.float64)  # counts of no word at all are integers
        others[at, best] = -np.inf
        margin = np.clip(gain[at, best] - others.max(1), 0, 30) if c > 1 else np.full(n, 30.0)
        sure = np.maximum(mass.sum(1), 1)
        below = (mass @ self.usual - got) / sure
        learned = (mass[at, best] >= total - mass.sum(1)) & (below < FAR + FAR_SHORT / np.sqrt(sure))
        score = np.where((total > 0) & learned, mass[at, best] / np.maximum(total, 1) / (1 + np.exp(-margin)), 0.0)
        head = np.flatnonzero(np.diff(doc, prepend=-1) | np.diff(path, prepend=-1))
        own, tail = doc[head], np.append(head[1:], len(row))
        first = (np.cumsum(size) - size)[own]
        runs: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        for d, a, z, k in zip(own.tolist(), (head - first).tolist(), (tail - first).tolist(), path[head].tolist()):
            runs[d].append((a, z, self.langs[k]))
        return [(self.langs[b], float(s), r) if t else ("und", 0.0, []) for b, s, t, r in zip(best.tolist(), score.tolist(), (total > 0).tolist(), runs)]


def viterbi(scores: np.ndarray, row: np.ndarray, size: np.ndarray, switch: float, span: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Best label of each word and the number of changes, for all documents at once.

    Documents are cut into spans of ``span`` words or more.  All spans run side by
    side, for each label of their first word: value[s, i, j] is the best score of span
    s from label i to label j.  Then the spans of each document are joined, which gives
    their first labels, and run once more from those, keeping for each word the best
    label before it and the labels that it is better to stay with.  So the number of
    steps is that of a span, however long a document is.
    """
    c, docs = scores.shape[1], len(size)
    span = max(span, -(-len(row) * c * c // SPAN_CELLS))
    first = np.cumsum(size) - size
    parts = -(-size // span)
    owner = np.repeat(np.arange(docs), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = first[owner] + nth * span
    length = np.minimum(span, first[owner] + size[owner] - begin)
    order = np.argsort(-length, kind="stable")
    start, steps = begin[order], int(length.max(initial=0))
    running = np.searchsorted(-length[order], -np.arange(steps), side="left")
    labels = np.arange(c, dtype=np.int16)
    value = np.full((len(order), c, c), -np.inf, np.float32)
    for t in range(steps):
        own = scores[row[start[: running[t]] + t]]
        if not t:
            value[:, labels, labels] = own
            continue
        v = value[: running[t]]
        np.maximum(v, v.max(2)[:, :, None] - switch, out=v)
        v += own[:, None, :]
    matrix = np.empty_like(value)
    matrix[order] = value
    del value

    # Join the spans of each document: the k-th spans of all documents that have one.
    base = np.cumsum(parts) - parts
    total = np.zeros((docs, c), np.float32)
    entry = np.zeros((len(owner), c), np.int16)  # first label of the span for its last label
    before = np.zeros((len(owner), c), np.int16)  # last label of the span before, for the first label
    for k in range(int(parts.max(initial=0))):
        d = np.flatnonzero(parts > k)
        s = base[d] + k
        if k:
            prev = total[d]
            top = prev.argmax(1)
            jump = prev.max(1)[:, None] - switch
            stay = prev >= jump
            before[s] = np.where(stay, labels, top[:, None].astype(np.int16))
            into = np.where(stay, prev, jump)
        else:
            into = np.zeros((len(d), c), np.float32)
        joined = into[:, :, None] + matrix[s]
        entry[s] = joined.argmax(1)
        total[d] = joined.max(1)
    del matrix

    end = np.zeros(len(owner), np.int16)
    head = np.zeros(len(owner), np.int16)
    label = total.argmax(1).astype(np.int16)
    for k in range(int(parts.max(initial=0)) - 1, -1, -1):
        d = np.flatnonzero(parts > k)
        s = base[d] + k
        end[s] = label[d]
        head[s] = entry[s, label[d]]
        label[d] = before[s, head[s]]

    # Once more from the first labels, now with the way back.
    best = np.full((len(order), c), -np.inf, np.float32)
    top, stays = np.zeros(len(row), np.int16), np.zeros((len(row), -(-c // 8)), np.uint8)
    for t in range(steps):
        a = running[t]
        at = start[:a] + t
        own = scores[row[at]]
        if not t:
            rows = np.arange(len(order))
            best[rows, head[order]] = own[rows, head[order]]
            continue
        v = best[:a]
        top[at] = v.argmax(1)
        jump = v.max(1)[:, None] - switch
        stays[at] = np.packbits(v >= jump, axis=1)
        best[:a] = np.maximum(v, jump) + own
    path = np.zeros(len(row), np.int16)
    now = end[order]
    for t in range(steps - 1, -1, -1):
        a = running[t]
        at = start[:a] + t
        path[at] = now[:a]
        if t:
            stay = stays[at, now[:a] >> 3] >> (7 - (now[:a] & 7)) & 1
            now[:a] = np.where(stay, now[:a], top[at])
    doc = np.repeat(np.arange(docs), size)
    change = (path[1:] != path[:-1]) & (doc[1:] == doc[:-1])
    return path, np.bincount(doc[1:][change], minlength=docs).astype(np.int64)


def held_out(id_col: str) -> Column:
    """Whether a row is kept for tests; a null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, usable: Column | None = None) -> Model:
    """A model from about ``sample`` labelled documents of each language.

    Counting runs on the executors, each language in one place; the driver gets one
    count vector for each language, which together are the model's table.
    """
    ok = F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()
    ok = ok & usable if usable is not None else ok
    sizes = {r[0]: r[1] for r in df.where(ok).groupBy(lang_col).count().collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0, np.int64), np.zeros(0))
    langs = sorted(sizes)
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1 << 30, int(sample / sizes[k] * (1 << 20)))))])
    picked = df.where(ok & (F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(7)), F.lit(1 << 20)) < share[F.col(lang_col)]))
    picked = picked.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).repartition("lang").sortWithinPartitions("lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, vector, bits, size = None, np.zeros(BUCKETS), 0, 0

        def made() -> Iterator[pa.RecordBatch]:
            if now is not None:
                yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([vector.astype(np.float32).tobytes()]), pa.array([bits]), pa.array([size])], ["lang", "counts", "bits", "letters"])

        for batch in batches:
            for first, texts in text_slices(batch, "text"):
                for lang, t in zip(batch.column(0).slice(first, len(texts)).to_pylist(), texts):
                    if lang != now:
                        yield from made()
                        now, vector, bits, size = lang, np.zeros(BUCKETS), 0, 0
                    words = [w for w in map(letters, t.split()) if w]
                    if words:
                        bucket, real, _, codes = grams(words)
                        vector += np.bincount(bucket[real], minlength=BUCKETS)
                        size += sum(map(len, words))
                        bits = int(np.bitwise_or.reduce(np.unique(scripts_of(words, codes)), initial=bits))
        yield from made()

    counts = np.zeros((BUCKETS, len(langs)), np.float32)
    scripts, size = np.zeros(len(langs), np.int64), np.zeros(len(langs), np.int64)
    for lang, vector, seen, n in picked.mapInArrow(vec.lean(count), "lang string, counts binary, bits long, letters long").toLocalIterator():
        at = langs.index(lang)
        counts[:, at] += np.frombuffer(vector, np.float32)
        scripts[at] |= seen
        size[at] += n
    table = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * BUCKETS))
    return Model(langs, table, scripts, (counts * table).sum(0) / np.maximum(size, 1))


def _worker(shared) -> Model:
    """The model of this Python worker, with its cache of words."""
    langs, table, scripts, usual = shared.value
    return vec.worker_slot(("langid", *langs, hash(table.tobytes())), lambda: Model(langs, table, scripts, usual))


def _shared(df: DataFrame, model: Model):
    """The model as a broadcast; its size is fixed by ``BUCKETS`` and the languages."""
    return df.sparkSession.sparkContext.broadcast((model.langs, model.table.astype(np.float32), model.scripts, model.usual))


def predict(df: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, lang_pred, score, spans.

    Spans are structs (start, end, lang) in order, by code points, the end exclusive.
    """
    kind = df.schema[id_col].dataType.simpleString()
    shared = _shared(df, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _worker(shared)
        for batch in batches:
            for first, texts in text_slices(batch, text_col, 2_000_000):
                lang, score, spans = zip(*m.label(texts))
                a, b, k = zip(*(x for s in spans for x in s)) if any(spans) else ((), (), ())
                each = pa.StructArray.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(k, pa.string())], ["start", "end", "lang"])
                spans = pa.ListArray.from_arrays(np.cumsum([0, *map(len, spans)]).astype(np.int32), each)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(lang), pa.array(score), spans], [id_col, "lang_pred", "score", "spans"])

    return df.select(id_col, text_col).mapInArrow(vec.lean(run, model=True), f"`{id_col}` {kind}, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")


def keep(df: DataFrame, model: Model, *, least: float = 0.5, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose language is known with a score of ``least`` or more, all columns.

    Texts in no learned language have score 0 and go.  A null label becomes the predicted language.
    """
    shared = _shared(df, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _worker(shared)
        for batch in batches:
            at = batch.schema.get_field_index(lang_col)
            for first, texts in text_slices(batch, text_col, 2_000_000):
                found = m.predict(texts)
                rows = batch.slice(first, len(texts))
                lang = pc.coalesce(rows.column(at), pa.array([x[0] for x in found], rows.column(at).type))
                rows = rows.set_column(at, batch.schema.field(at).name, lang)
                yield rows.filter(pa.array([x[0] != "und" and x[1] >= least for x in found]))

    return df.mapInArrow(vec.lean(run, model=True), df.schema)
