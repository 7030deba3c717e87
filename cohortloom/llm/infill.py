"""Fill-in-the-middle: cut whole texts into prefix, middle and suffix and write them in another order.

A batch of texts is one run of bytes. The start of every unit (a run of letters, or one other character) comes from comparing neighbouring
bytes; the cuts of a text are the places of two of its units. Every part of a text moves by one distance, so an array that is 0
except where parts begin, and there holds the change of the distance, gives each byte its shift by a cumulative sum; the bytes are then scattered
into the output. The way back looks for the marks in the output, builds the same kind of array from them, and gathers.

Shifts are summed chunk by chunk with a carry, so memory is that of texts and outputs, not eight bytes for each of their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.texts import slices

MARKS = (b"<P>", b"<S>", b"<M>")
SALT = "1"
PLAIN_FROM = 90  # of 100: these and the following stay as they are
SPM_BELOW = 20  # of 100: these have the suffix first
CHUNK = 1 << 20
FORMS = ("plain", "psm", "spm")
RESULT = "n long, form string, prefix_chars long, middle_chars long"


def unit_starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Whether a unit ([A-Za-z]+ or one other code point) starts at each byte; ``begins`` are the first bytes of texts."""
    out = np.empty(len(data), bool)
    before = False
    for at in range(0, len(data), CHUNK):
        part = data[at:at + CHUNK]
        letter = ((part | 32) >= 97) & ((part | 32) <= 122)
        own = out[at:at + CHUNK]
        own[0], own[1:] = before, letter[:-1]
        own &= letter
        np.logical_not(own, out=own)
        own &= (part & 0xC0) != 0x80  # later bytes of a code point
        before = letter[-1]
    out[begins] = True
    return out


def counted(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Number of flags before each of the (rising) places."""
    return np.cumsum([np.count_nonzero(flags[a:b]) for a, b in zip(np.concatenate([[0], ends[:-1]]), ends)], dtype=np.int64)


def place_of(flags: np.ndarray, nth: int) -> int:
    """Index of the ``nth`` flag (from 0), or the length if there are no more."""
    if len(flags) <= CHUNK:
        found = np.flatnonzero(flags)
        return int(found[nth]) if nth < len(found) else len(flags)
    for at in range(0, len(flags), CHUNK):
        many = np.count_nonzero(flags[at:at + CHUNK])
        if nth < many:
            return at + place_of(flags[at:at + CHUNK], nth)
        nth -= many
    return len(flags)


def moved(source: np.ndarray, size: int, edges: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Scatter: the bytes from each (rising) edge to the next move by the edge's shift into an output of ``size`` bytes."""
    out = np.empty(size, np.uint8)
    delta = np.diff(shifts, prepend=0)
    carry = 0
    for at in range(0, len(source), CHUNK):
        part = source[at:at + CHUNK]
        a, b = np.searchsorted(edges, [at, at + len(part)])
        step = np.zeros(len(part), np.int64)
        np.add.at(step, edges[a:b] - at, delta[a:b])
        step[0] += carry
        shift = np.cumsum(step)
        carry = shift[-1]
        out[np.arange(at, at + len(part)) + shift] = part
    return out


def gathered(output: np.ndarray, size: int, edges: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Gather: byte i of the text (of ``size`` bytes) is byte i + shift of the output, by the last edge up to i."""
    out = np.empty(size, np.uint8)
    delta = np.diff(shifts, prepend=0)
    carry = 0
    for at in range(0, size, CHUNK):
        many = min(CHUNK, size - at)
        a, b = np.searchsorted(edges, [at, at + many])
        step = np.zeros(many, np.int64)
        np.add.at(step, edges[a:b] - at, delta[a:b])
        step[0] += carry
        shift = np.cumsum(step)
        carry = shift[-1]
        out[at:at + many] = output[np.arange(at, at + many) + shift]
    return out


def draws(doc_id: int | None, salt: str) -> list[int]:
    """Four whole numbers from the id; a null id counts as the empty text."""
    digest = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]


def arrange(texts: list[bytes], ids: list[int | None], salt: str = SALT) -> dict[str, list]:
    """Per text: n, form, prefix_chars, middle_chars and the output."""
    length = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(length)
    begins = ends - length
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = unit_starts(data, begins[length > 0])
    total = counted(starts, ends) if len(texts) else np.zeros(0, np.int64)
    units = np.diff(total, prepend=0)
    forms, cuts = [], np.zeros((len(texts), 2), np.int64)
    for i, text in enumerate(texts):
        n = int(units[i])
        h1, h2, h3, h4 = draws(ids[i], salt)
        if not text or any(m in text for m in MARKS) or h3 % 100 >= PLAIN_FROM:
            forms.append("plain")
            continue
        forms.append("spm" if h4 % 100 < SPM_BELOW else "psm")
        own = starts[begins[i]:ends[i]]
        cuts[i] = [place_of(own, k) for k in sorted((h1 % (n + 1), h2 % (n + 1)))]
    form = np.array([FORMS.index(f) for f in forms], np.int64)
    size = length + np.where(form > 0, 9, 0)
    target = np.cumsum(size) - size
    prefix, middle, suffix = cuts[:, 0], cuts[:, 1] - cuts[:, 0], length - cuts[:, 1]
    # Where each part goes, from the output's start: <P>prefix<S>suffix<M>middle, or <S>suffix<P>prefix<M>middle.
    spm = form == 2
    to_prefix = np.where(spm, suffix + 6, 3)
    to_suffix = np.where(spm, 3, prefix + 6)
    to_middle = prefix + suffix + 9
    plain = form == 0
    edges = np.stack([begins, begins + prefix, begins + cuts[:, 1]], axis=1)
    shifts = target[:, None] + np.stack([to_prefix, to_middle - prefix, to_suffix - cuts[:, 1]], axis=1) - begins[:, None]
    shifts[plain] = (target - begins)[plain, None]
    out = moved(data, int(size.sum()), *last_of(edges.ravel(), shifts.ravel()))
    cut = ~plain
    for mark, at in zip(MARKS, (to_prefix - 3, to_suffix - 3, to_middle - 3)):
        for k in range(3):
            out[(target + at)[cut] + k] = mark[k]
    whole = memoryview(out)
    lead = (data & 0xC0) != 0x80 if len(data) <= CHUNK else None

    def chars(i: int, a: int, b: int) -> int:
        a, b = int(begins[i] + a), int(begins[i] + b)
        if lead is not None:
            return int(np.count_nonzero(lead[a:b]))
        return sum(int(np.count_nonzero((data[c:min(b, c + CHUNK)] & 0xC0) != 0x80)) for c in range(a, b, CHUNK))

    return {"n": units.tolist(), "form": forms, "prefix_chars": [None if plain[i] else chars(i, 0, cuts[i, 0]) for i in range(len(texts))],
            "middle_chars": [None if plain[i] else chars(i, cuts[i, 0], cuts[i, 1]) for i in range(len(texts))],
            "output": [whole[a:a + s] for a, s in zip(target.tolist(), size.tolist())]}


def last_of(edges: np.ndarray, shifts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of edges at one place (empty parts) the last counts."""
    keep = np.ones(len(edges), bool)
    keep[:-1] = edges[1:] != edges[:-1]
    return edges[keep], shifts[keep]


def restore(outputs: list[bytes | memoryview], forms: list[str]) -> list[memoryview]:
    """The texts, from outputs and forms alone."""
    length = np.array([len(o) for o in outputs], np.int64)
    source = np.cumsum(length) - length
    cut = np.array([f != "plain" for f in forms], bool)
    size = length - np.where(cut, 9, 0)
    begins = np.cumsum(size) - size
    edges, shifts = np.repeat(begins, 3).reshape(-1, 3), np.repeat(source - begins, 3).reshape(-1, 3)
    for i in np.flatnonzero(cut):
        text = bytes(outputs[i])
        p, s, m = (text.index(mark) for mark in MARKS)
        prefix, suffix = ((s if p < s else m) - p - 3, (m if p < s else p) - s - 3)
        middle = len(text) - m - 3
        edges[i] += [0, prefix, prefix + middle]
        shifts[i] += [p + 3, m + 3 - prefix, s + 3 - prefix - middle]
    data = np.frombuffer(b"".join(outputs), np.uint8)
    out = memoryview(gathered(data, int(size.sum()), *last_of(edges.ravel(), shifts.ravel())))
    return [out[a:a + n] for a, n in zip(begins.tolist(), size.tolist())]


def transform(documents: DataFrame, salt: str = SALT) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output (text) of every row.

    A null or empty text is plain and empty with n = 0, so is a null id's as any other's (its draws are those of the empty id). Repeated
    rows give equal rows. Texts of any length are moved whole; a batch holds about 2 MB of text, or one longer text. An empty
    table gives no rows; columns other than doc_id and text are not read.
    """
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in slices(batches):
            got = arrange(texts, b.column("doc_id").to_pylist(), salt)
            output = pa.array([bytes(o) for o in got["output"]], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got["n"], pa.int64()), pa.array(got["form"], pa.string()), pa.array(got["prefix_chars"], pa.int64()),
                                              pa.array(got["middle_chars"], pa.int64()), output], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(go, f"doc_id long, {RESULT}, output string")


def digest(transformed: DataFrame) -> DataFrame:
    """Rows of ``transform`` with hashes of the output and of the text restored from it, in place of the output."""
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, outputs in slices(batches, "output"):
            texts = restore(outputs, b.column("form").to_pylist())
            hashes = [pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string()) for xs in (outputs, texts)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars")), *hashes],
                                             ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])

    return transformed.mapInArrow(go, f"doc_id long, {RESULT}, output_sha256 string, restored_sha256 string")


SQL = """
WITH units AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM units),
formed AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
cut AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(text) AS restored_sha256 FROM cut
"""


def op12_infill(spark, sf_dir: str) -> DataFrame:
    """The fill-in-the-middle form of every document, and proof that it gives the text back."""
    return digest(transform(spark.read.parquet(f"{sf_dir}/documents.parquet")))
