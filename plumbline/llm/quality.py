"""Quality rules from repetition coverage.

Rolling hashes of n-word windows (several n) and of whole lines are computed in
numpy over raw UTF-8 bytes, for many documents at a time.  A window is repeated
if its hash occurs twice or more in its document; coverage of n is the share of
word characters that lie in repeated windows of n words, and line coverage the
share of the text's characters that lie in lines equal to an earlier line.

Defined cases: null and empty texts have no words and fail the base rule.
Equal documents get equal verdicts, so repeated rows too.  Texts of any length are
measured whole.  Other columns of the input are ignored, whatever their names; an
empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm import vec

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True

#: Most allowed share of word characters in repeated windows, by window length.
COVERAGE = {3: 0.45, 5: 0.35, 8: 0.30, 13: 0.25}
#: Most allowed share of characters in repeated lines, and of symbols to words.
LINES, SYMBOL_RATIO = 0.30, 0.40


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive edges."""
    c = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=c[1:])
    return c[edges[1:]] - c[edges[:-1]]


def _covered(w: vec.Words, doc: np.ndarray, n: int) -> np.ndarray:
    """Mask of words that lie in a repeated window of n words."""
    start, h = vec.windows(w, n)
    hit = start[vec.repeated(vec.doc_keys(h, doc[start]))] if len(start) else start
    step = np.zeros(len(w.hashes) + 1, dtype=np.int32)
    np.add.at(step, hit, 1)
    np.add.at(step, hit + n, -1)
    return np.cumsum(step[:-1]) > 0


def measure(data: np.ndarray, offs: np.ndarray, coverage: dict[int, float] = COVERAGE) -> dict[str, np.ndarray]:
    """Counts and coverages of each document in one run of documents."""
    w = vec.tokenise(data, offs)
    docs, doc = len(offs) - 1, w.doc
    lead = (data & 0xC0) != 0x80
    chars = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(lead, out=chars[1:])
    word_chars = chars[w.ends] - chars[w.starts]
    out = {"n_words": np.diff(w.first), "word_chars": _sums(word_chars, w.first), "n_symbols": _sums(SYMBOLS[data], offs)}

    breaks = np.flatnonzero(data == 10)
    begins = np.unique(np.concatenate([offs[:-1], breaks + 1]))
    line_doc = np.searchsorted(offs, begins, side="right") - 1
    after_last = np.searchsorted(breaks, begins)
    ends = np.append(breaks, len(data))[after_last]
    ends = np.minimum(ends, offs[np.minimum(line_doc + 1, docs)])
    live = ends > begins
    begins, ends, line_doc = begins[live], ends[live], line_doc[live]
    has_word = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, begins)
    begins, ends, line_doc = begins[has_word], ends[has_word], line_doc[has_word]
    dup = vec.later(vec.doc_keys(vec.hash_range(w.prefix, begins, ends), line_doc))
    out["n_dup_lines"] = np.bincount(line_doc[dup], minlength=docs).astype(np.int64)
    dup_chars = np.bincount(line_doc[dup], weights=(chars[ends] - chars[begins])[dup], minlength=docs)
    out["line_coverage"] = dup_chars / np.maximum(chars[offs[1:]] - chars[offs[:-1]], 1)

    for n in sorted({5, *coverage}):
        covered = _covered(w, doc, n)
        if n == 5:
            out["n_repeat_words"] = _sums(covered, w.first)
        if n in coverage:
            out[f"coverage_{n}"] = _sums(word_chars * covered, w.first) / np.maximum(out["word_chars"], 1)
    return out


def verdict(m: dict[str, np.ndarray], coverage: dict[int, float] = COVERAGE) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept)."""
    failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    bad = m["line_coverage"] > LINES
    bad |= m["n_symbols"] > SYMBOL_RATIO * m["n_words"]
    for n, most in coverage.items():
        bad |= m[f"coverage_{n}"] > most
    return failed, ~failed & ~bad


def rules(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", coverage: dict[int, float] = COVERAGE) -> DataFrame:
    """One row for each input row: counts, coverages, base_failed and kept."""
    kind = df.schema[id_col].dataType.simpleString()
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    shares = ["line_coverage", *(f"coverage_{n}" for n in sorted(coverage))]
    schema = ", ".join([f"`{id_col}` {kind}", *(f"{c} long" for c in counts), "base_failed boolean", "kept boolean", *(f"{c} double" for c in shares)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = vec.text_buffers(batch.column(1))
            for i, j in vec.spans(offs, 2_000_000):
                m = measure(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], coverage)
                failed, kept = verdict(m, coverage)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), *(pa.array(m[c], pa.int64()) for c in counts), pa.array(failed), pa.array(kept), *(pa.array(m[c], pa.float64()) for c in shares)],
                    [id_col, *counts, "base_failed", "kept", *shares],
                )

    return df.select(id_col, text_col).mapInArrow(run, schema)
