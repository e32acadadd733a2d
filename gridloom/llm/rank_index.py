"""Fill-in-the-middle forms of documents, cut with a learned rank index.

A text is cut into tokens (runs of A-Z letters, or one other code point) and the
two cuts are token ranks drawn from a hash of the ``doc_id``. Where a rank lies
in the text comes from an index over all token boundaries of a slice of texts:
straight segments map ranks to offsets with an error of at most ``ERROR``, and
what each boundary differs from its segment is stored as one signed byte. A cut
is looked up by finding its segment, predicting, and adding the residual, which
is exact.

Segments are fitted greedily: from its first boundary a segment keeps the cone
of slopes that stay within the error for all boundaries so far, and ends where
the cone is empty. The cone is computed for doubling windows at once.

At scale: one pass over the texts without a shuffle. A slice is some megabytes,
or one longer text, and its index lives as long as the slice.

Null texts count as empty: form plain, no tokens, an empty output. A null
``doc_id`` is drawn as the empty decimal. Texts that hold a marker stay plain.
Repeated rows give equal rows, one each. An empty table gives no rows; extra
columns are ignored. Equal draws give an empty middle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.textnum import slices

ERROR = 126  # one more for rounding still fits a signed byte
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = True


class RankIndex:
    """Rank to offset of an increasing array, by segments and residuals."""

    def __init__(self, offsets: np.ndarray, error: int = ERROR):
        starts, slopes = [], []
        at, n, window = 0, len(offsets), 1024
        while at < n:
            low, high, end = 0.0, np.inf, at + 1
            while end < n:
                upto = min(n, end + window)
                run = np.arange(end - at, upto - at)
                rise = (offsets[end:upto] - offsets[at]).astype(float)
                floor = np.maximum.accumulate(np.maximum((rise - error) / run, low))
                ceiling = np.minimum.accumulate(np.minimum((rise + error) / run, high))
                bad = np.flatnonzero(floor > ceiling)
                held = int(bad[0]) if len(bad) else len(run)
                if held:
                    low, high = floor[held - 1], ceiling[held - 1]
                end += held
                if len(bad):
                    break
                window *= 2
            starts.append(at)
            slopes.append((low + high) / 2 if end > at + 1 else 0.0)
            window = max(64, min(1 << 20, end - at))
            at = end
        self.starts, self.slopes = np.array(starts, np.int64), np.array(slopes)
        self.heads = offsets[self.starts] if n else np.zeros(0, np.int64)
        self.residuals = np.zeros(0, np.int8)
        difference = offsets - self.predict(np.arange(n))
        if n and np.abs(difference).max() > 127:
            raise ArithmeticError("a boundary is farther from its segment than the error allows")
        self.residuals = difference.astype(np.int8)

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        """Offsets by the segments alone, within the error."""
        if not len(self.starts):
            return np.zeros(len(ranks), np.int64)
        at = np.searchsorted(self.starts, ranks, "right") - 1
        return self.heads[at] + np.rint(self.slopes[at] * (ranks - self.starts[at])).astype(np.int64)

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        """Exact offsets."""
        return self.predict(ranks) + self.residuals[ranks]


def boundaries(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte offsets where a token starts, tokens ending with their row, and the end of the slice."""
    begin = (data & 0xC0) != 0x80
    letter = LETTERS[data]
    begin[1:] &= ~(letter[1:] & letter[:-1])
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[heads] = True
    return np.append(np.flatnonzero(begin), len(data))


def draws(doc_id: int | None) -> tuple[int, ...]:
    """Four 32-bit numbers of an id."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def arranged(text: bytes, one: int, two: int, form: str) -> bytes:
    prefix, middle, suffix = text[:one], text[one:two], text[two:]
    if form == "psm":
        return PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    if form == "spm":
        return SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return text


def _transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        for first, data, offsets in slices(batch.column("text")):
            rows = len(offsets) - 1
            bounds = boundaries(data, offsets)
            index = RankIndex(bounds)
            base = np.searchsorted(bounds[:-1], offsets)
            tokens = np.diff(base)
            drawn = [draws(i) for i in ids[first : first + rows]]
            cut = np.sort([[h[0] % (n + 1), h[1] % (n + 1)] for h, n in zip(drawn, tokens.tolist())], axis=1)
            places = index.offsets((cut + base[:-1, None]).ravel()).reshape(rows, 2)
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            prefix = points[places[:, 0]] - points[offsets[:-1]]
            middle = points[places[:, 1]] - points[places[:, 0]]
            raw, forms, outputs = data.tobytes(), [], []
            for row in range(rows):
                text = raw[offsets[row] : offsets[row + 1]]
                h = drawn[row]
                marked = any(m in text for m in (PREFIX, SUFFIX, MIDDLE))
                form = "plain" if not text or marked or h[2] % 100 >= PLAIN_FROM else "spm" if h[3] % 100 < SPM_BELOW else "psm"
                forms.append(form)
                outputs.append(arranged(text, places[row, 0] - offsets[row], places[row, 1] - offsets[row], form))
            plain = np.array([f == "plain" for f in forms])
            arrays = [
                batch.column("doc_id").slice(first, rows), pa.array(tokens, pa.int64()), pa.array(forms, pa.string()),
                pa.array(prefix, pa.int64(), mask=plain), pa.array(middle, pa.int64(), mask=plain), pa.array(outputs, pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names)


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of ``docs`` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _transform, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of; markers are found by search, not from stored lengths."""
    body = F.substr(output, F.lit(4))  # without its first marker

    def parts(second: str) -> tuple[Column, Column, Column]:
        one = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(one) + 4)
        two = F.substring_index(rest, MIDDLE.decode(), 1)
        return one, two, F.substr(rest, F.length(two) + 4)

    prefix, suffix, middle = parts(SUFFIX.decode())
    back, front, between = parts(PREFIX.decode())
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(front, between, back)).otherwise(output)
