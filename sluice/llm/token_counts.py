"""Token counts of whole texts, with huge documents encoded in overlapping chunks that are spliced where both agree.

Texts of more than `huge` characters are encoded in chunks of `chunk` characters, each beginning `overlap` characters before the end of the
one before it. The tokens of two neighbours are spliced at a common boundary: a place in the overlap at which the same token begins in both, and which is
proven to be a boundary whatever stands around it (`stable`). Where the overlap has none, it is doubled, and once it has used up the chunk, the chunk
itself is. A text without any such place is thus encoded as a whole, and every count is that of the whole text. A task holds the encoding of one
chunk and its neighbour, not of the text.

Why a stable place is a boundary: the vocabulary's pre-tokenizer is a regular expression that goes from left to right; its matches are runs of letters,
of digits, of other visible characters (each with one space before it, perhaps), of white space, or one of seven contractions that begin with an apostrophe. No match goes on from a visible
character to white space, or from one kind of visible character to another, but for the contractions. And a match that begins at a boundary depends on what follows only. Places
near a special string (taken out of the text first) are not stable, nor are characters whose kind differs between versions of Unicode.

Shorter texts fall into pieces at such places too (a visible character before ASCII white space); a worker encodes a piece once and remembers its count.

Null text: no bytes and no tokens. Empty text: likewise. Null ids: counted as any other row, with null id. Repeated rows are counted each. Columns
other than id and text are ignored, whatever their names. No rows give no rows. Bytes that aren't UTF-8 count as they stand in n_bytes, and as U+FFFD for tokens.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import by_size, table, worker_cache

#: Pieces whose counts a worker remembers.
PIECES = 1_000_000
BLANKS = " \t\n\r\x0b\x0c"
#: White space beside ASCII's, and characters that some versions of Unicode count as such.
RARE_BLANKS = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")
PIECE = re.compile(f"[{BLANKS}]*[^{BLANKS}]+|[{BLANKS}]+")


def kind(c: str) -> str | None:
    """L (letter), N (number), P (other visible), blank for ASCII white space; null where versions of Unicode may differ."""
    if c in BLANKS:
        return " "
    now, then = unicodedata.category(c), unicodedata.ucd_3_2_0.category(c)
    if now[0] != then[0] or now[0] in "CZ":
        return None
    return now[0] if now[0] in "LN" else "P"


def stable(text: str, at: int, special: list[str]) -> bool:
    """Whether a boundary stands before text[at] in every text that holds its surroundings."""
    left, right = kind(text[at - 1]), kind(text[at])
    if left in (None, " ") or right is None or left == right or (text[at - 1] == "'" and right == "L"):
        return False
    return not any(s in text[max(0, at - len(s)) : at + len(s)] for s in special)


class Counter:
    """Counts of a byte-level vocabulary file of the `tokenizers` library."""

    def __init__(self, path: str | None, chunk: int, overlap: int, huge: int):
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        path = path or public_tokenizers.path("byte_bpe_50k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.chunk, self.overlap, self.huge = chunk, overlap, huge
        self.known: dict[str, int] = {}
        # Bytes are spelled as characters: printable ones as themselves, the others from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.spelling = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}

    def encoded(self, text: str, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """First characters (in the whole text) and ids of the tokens of text[lo:hi]."""
        e = self.tokenizer.encode(text[lo:hi], add_special_tokens=False)
        return np.array([o[0] for o in e.offsets], np.int64) + lo, np.array(e.ids, np.int64)

    def splice(self, text: str, a, b, lo: int, hi: int) -> int | None:
        """Last stable place in text[lo + 1:hi] at which the same token begins in both encodings."""
        (starts_a, at_a), (starts_b, at_b) = (np.unique(x[0], return_index=True) for x in (a, b))
        common, in_a, in_b = np.intersect1d(starts_a, starts_b, assume_unique=True, return_indices=True)
        same = (a[1][at_a[in_a]] == b[1][at_b[in_b]]) & (common > lo) & (common < hi)
        return next((int(x) for x in common[same][::-1] if stable(text, int(x), self.special)), None)

    def by_chunks(self, text: str) -> int:
        """Tokens of a text, from overlapping chunks."""
        size, total = len(text), 0
        lo, hi, good = 0, min(self.chunk, size), 0  # tokens of text[lo:hi] count from `good` on
        here = self.encoded(text, lo, hi)
        while hi < size:
            at, overlap = None, self.overlap
            while at is None and hi - overlap > good:
                low, high = hi - overlap, min(hi + self.chunk, size)
                there = self.encoded(text, low, high)
                at, overlap = self.splice(text, here, there, low, hi), overlap * 2
            if at is None:  # no such place in the whole chunk
                hi = min(size, hi + (hi - lo))
                here = self.encoded(text, lo, hi)
                continue
            total += int(np.searchsorted(here[0], at) - np.searchsorted(here[0], good))
            lo, hi, good, here = low, high, at, there
        return total + len(here[0]) - int(np.searchsorted(here[0], good))

    def learn(self, missing: list[str]) -> None:
        """Add the counts of pieces not yet known."""
        others = []
        for piece in missing:
            # Letters followed by a full stop or comma: the mark is a token by itself.
            mark = piece[-1] in ".," and len(piece) > 1
            core = piece[:-1] if mark else piece
            word = core[1:] if core[0] == " " else core
            if word.isalpha() and max(word) < "\u0250":  # one match, which the model takes as it stands
                spelled = core.encode().decode("latin-1").translate(self.spelling)
                self.known[piece] = len(self.tokenizer.model.tokenize(spelled)) + mark
            else:
                others.append(piece)
        found = self.tokenizer.encode_batch_fast(others, add_special_tokens=False)
        self.known.update(zip(others, map(len, found), strict=True))

    def counts(self, texts: list[bytes]) -> list[int]:
        """Tokens of each text."""
        out, before = [], len(self.known)
        for data in texts:
            text = data.decode("utf-8", "replace")
            if len(text) > self.huge:
                out.append(self.by_chunks(text))
            elif RARE_BLANKS.search(text) or any(s in text for s in self.special):
                out.append(len(self.tokenizer.encode(text, add_special_tokens=False)))
            else:
                pieces = PIECE.findall(text)
                self.learn([p for p in dict.fromkeys(pieces) if p not in self.known])
                out.append(sum(map(self.known.__getitem__, pieces)))
        if len(self.known) > PIECES:  # dictionaries keep their order: the newest pieces go
            for piece in list(itertools.islice(reversed(self.known), len(self.known) - min(before, PIECES))):
                del self.known[piece]
        return out


def _count(path: str | None, chunk: int, overlap: int, huge: int):
    def run(batches):
        counter = worker_cache(f"counter_{path}_{chunk}_{overlap}_{huge}", lambda: Counter(path, chunk, overlap, huge))
        for batch in batches:
            for lo, hi, texts in by_size(batch.column(1), 1 << 20):
                sizes = [len(t or b"") for t in texts]
                counts = counter.counts([t or b"" for t in texts])
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    return run


def count(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 512, chunk: int = 16_384, overlap: int = 128, huge: int = 32_768) -> DataFrame:
    """Id, n_bytes, n_tokens and over_limit (more than `limit` tokens) of every row. Texts are counted where they are read, without a shuffle."""
    if min(chunk, overlap) < 1 or overlap >= chunk:
        raise ValueError("an overlap is at least one character and shorter than a chunk")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_count(path, chunk, overlap, huge), "id long, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`op13_token_counts`: all documents with the vocabulary of byte_bpe_50k.json."""
    return count(table(spark, sf_dir, "documents"))
