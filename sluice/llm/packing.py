"""Best-fit packing of documents into token sequences by bin completion.

Each text is encoded with a given vocabulary, ends with the end id, and is cut only where it is longer than a
sequence. The pieces are dealt by a hash of (id, piece) into groups of about `group_rows` pieces, so a hot
source or length never gathers in one task, and each group is packed by itself: a group can cost at most the
one sequence that it leaves open.

Within a group, best-fit decreasing gives the first incumbent. If it uses more sequences than
ceil(tokens / capacity), bin completion searches on: the largest open piece starts a sequence, its undominated
fillings are enumerated as the search asks for them (no filling in which a piece could be swapped for a larger open one, or another
added), those of less waste first; only fillings are looked at whose waste leaves room for an improvement on the
incumbent. The search stops at the bound or after `nodes` sequences tried, but not before `descents` times the
sequences of the first incumbent (a complete packing tries one a sequence), keeping the incumbent; it also stops after `effort` steps of
enumeration per piece of the group. Each band of waste of one enumeration gives up after 2,000 steps: fillings that it had not come to by then are not tried, so the search is then no
longer complete. Every piece is packed all the same, at worst as the incumbent has it.

Null text: empty, so the end id alone. Null ids: packed as any other row, with null id. Repeated rows are
packed each. Columns other than id and text are ignored. No rows give no pieces.
"""

from __future__ import annotations

import bisect
import itertools
import sys
import zlib
from array import array
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import Scratch, by_size, lean, table, worker_cache

#: Words whose ids a worker remembers.
WORDS = 100_000
#: Bytes of text that a task encodes at once, and rows that it is handed at once.
CHUNK, BATCH = 1_000_000, 1_000
PIECE_DDL = "id long, row_key long, piece int, start long, length long, ids_crc32 long, ids binary"


class WordIds:
    """Ids of white-space separated words as bytes. The vocabulary splits at white space, so words are encoded alone."""

    def __init__(self, path: str | None):
        import os

        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))
        self.tokenizer.encode_special_tokens = False
        self.known: dict[bytes, bytes] = {}
        assert sys.byteorder == "little" and array("I").itemsize == 4

        self.model = self.tokenizer.model
        # The vocabulary spells bytes as characters: printable ones as themselves, the others from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.spelling = {b: c for b, c in zip((b for b in range(256) if b not in plain), range(256, 512), strict=False)}
        self.marks = dict(zip((b".", b","), self._encode([".", ","]), strict=True))

    def _encode(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(words, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def learn(self, missing: list[bytes]) -> None:
        """Add the ids of words not yet known."""
        known, tokenize, spelling = self.known, self.model.tokenize, self.spelling
        others = []
        for word in missing:
            # Letters followed by a full stop or comma are the word and then the mark.
            mark = self.marks.get(word[-1:], b"")
            core = word[:-1] if mark else word
            text = core.decode("utf-8", "replace").lower()
            lower = text.encode()
            if lower in known and text.isalpha():
                known[word] = known[lower] + mark if mark else known[lower]
            elif text.isalpha() and (text.isascii() or max(text) < "\u0100"):
                # Letters are one unit to the vocabulary, already normalised: straight to the model.
                if not text.isascii():
                    text = lower.decode("latin-1").translate(spelling)
                ids = known[lower] = array("I", [t.id for t in tokenize(text)]).tobytes()
                if word != lower:
                    known[word] = ids + mark if mark else ids
            else:
                others.append(word)
        known.update(zip(others, self._encode([w.decode("utf-8", "replace") for w in others]), strict=True))

    def texts(self, texts: list[bytes]) -> list[bytes]:
        """Ids of whole texts, as little-endian unsigned 32-bit numbers."""
        split = [t.split() for t in texts]
        before, known = len(self.known), self.known
        self.learn([w for w in set().union(*split) if w not in known])
        get = self.known.__getitem__
        out = [b"".join(map(get, words)) for words in split]
        if len(known) > WORDS:  # dictionaries keep their order: the newest words go
            for word in list(itertools.islice(reversed(known), len(known) - min(before, WORDS))):
                del known[word]
        return out


def _pieces(capacity: int, end_id: int, path: str | None, keep_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        words = worker_cache(f"word_ids_{path}", lambda: WordIds(path))
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, _, texts in by_size(batch.column(2), CHUNK, 500):
                rows = []
                for k, data in enumerate(words.texts([t or b"" for t in texts]), lo):
                    data += end
                    for piece, at in enumerate(range(0, len(data), capacity * 4)):
                        part = data[at : at + capacity * 4]
                        rows.append((ids[k], keys[k], piece, at // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None))
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["id", "row_key", "piece", "start", "length", "ids_crc32", "ids"])

    return run


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing over lengths in descending order: each into the fullest bin that takes it."""
    rooms: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for x in lengths:
        at = bisect.bisect_left(rooms, (x, -1))
        if at == len(rooms):
            bins.append([x])
            room = (capacity - x, len(bins) - 1)
        else:
            room, b = rooms.pop(at)
            bins[b].append(x)
            room = (room - x, b)
        if room[0]:
            bisect.insort(rooms, room)
    return bins


class Budget:
    """Steps that a search may still take."""

    def __init__(self, steps: int):
        self.left, self.taken = steps, 0


def fillings(largest: int, counts: Counter, sizes: list[int], capacity: int, allowed: int, budget: Budget):
    """Every undominated filling of the room beside `largest` that wastes at most `allowed`, those of less waste first.

    sizes: all lengths, ascending; counts: how many of each are open. A filling is dominated if another open piece fits beside it, or could take the place of a smaller one
    in it. Fillings are enumerated as they are asked for, in bands of waste (none, then up to 3, 15, 63, ..), largest pieces first, with the budget's steps for each band.
    """
    room = capacity - largest
    first = next((i for i, x in enumerate(sizes) if counts[x]), len(sizes))
    least = sizes[first] if first < len(sizes) else capacity + 1

    def smallest_open(used: Counter) -> int:
        return next((sizes[i] for i in range(first, len(sizes)) if counts[sizes[i]] > used[sizes[i]]), capacity + 1)

    def dominated(left: int, used: Counter) -> bool:
        if left == 0:
            return False
        if smallest_open(used) <= left:
            return True
        for x in used:
            at = bisect.bisect_right(sizes, x + left) - 1
            while at >= 0 and sizes[at] > x:
                if counts[sizes[at]] > used[sizes[at]]:
                    return True
                at -= 1
        return False

    def search(left: int, most: int, used: Counter, low: int, high: int):
        if low <= left <= high and not dominated(left, used):
            yield left
        if left == 0:
            return
        at = bisect.bisect_right(sizes, min(left, most)) - 1
        while at >= first and budget.left > 0:
            x = sizes[at]
            budget.left -= 1
            budget.taken += 1
            if high < left - x < least:  # neither full nor to be filled further
                at = bisect.bisect_right(sizes, left - least) - 1
                continue
            if counts[x] > used[x]:
                used[x] += 1
                yield from search(left - x, x, used, low, high)
                used[x] -= 1
                if not used[x]:
                    del used[x]
            at -= 1

    low, high, steps = 0, 0, budget.left
    while low <= allowed:
        budget.left, used = steps, Counter()
        for _ in search(room, room, used, low, min(high, allowed)):
            yield tuple(sorted(used.elements(), reverse=True))
        low, high = high + 1, 4 * high + 3


def bin_completion(lengths: list[int], capacity: int, nodes: int = 20_000, descents: int = 4, effort: int = 500) -> list[list[int]]:
    """Bins of the given lengths (all at most `capacity`), as few as the search finds."""
    lengths = sorted(lengths, reverse=True)
    best, total = best_fit(lengths, capacity), sum(lengths)
    bound = -(-total // capacity)
    spent, nodes = 0, max(nodes, descents * len(best))
    steps, each = effort * len(lengths), 2000
    while len(best) > bound and spent < nodes and steps > 0:
        allowed = (len(best) - 1) * capacity - total  # waste of any better packing
        counts = Counter(lengths)
        sizes = sorted(counts)
        stack: list[list] = []  # [largest, fillings left, filling in place, its waste, steps]
        waste, found, top_at = 0, False, len(sizes) - 1
        while spent < nodes and steps > 0:
            while top_at >= 0 and not counts[sizes[top_at]]:
                top_at -= 1
            if top_at < 0:
                found = True
                break
            largest = sizes[top_at]
            counts[largest] -= 1
            spent += 1
            budget = Budget(each)
            stack.append([largest, fillings(largest, counts, sizes, capacity, allowed - waste, budget), (), 0, budget])
            while stack:
                top = stack[-1]
                for x in top[2]:
                    counts[x] += 1
                waste -= top[3]
                top[2], top[3] = (), 0
                taken = top[4].taken
                filling = next(top[1], None)
                steps -= top[4].taken - taken
                if filling is not None:
                    top[2], top[3] = filling, capacity - top[0] - sum(filling)
                    waste += top[3]
                    for x in filling:
                        counts[x] -= 1
                    break
                counts[top[0]] += 1
                top_at = bisect.bisect_left(sizes, top[0])
                stack.pop()
            if not stack:
                break
        if not found:
            break
        best = [[s[0], *s[2]] for s in stack]
    return best


def _pack_group(capacity: int, nodes: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "id", "row_key", "piece"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        waiting: dict[int, list[int]] = {}
        for at, length in enumerate(part["length"].tolist()):
            waiting.setdefault(length, []).append(at)
        for same in waiting.values():
            same.reverse()
        sequence, offset = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
        base = int(part["grp"].iloc[0]) << 32
        for b, bin_ in enumerate(bin_completion(part["length"].tolist(), capacity, nodes)):
            place = 0
            for length in bin_:
                at = waiting[length].pop()
                sequence[at], offset[at] = base + b, place
                place += length
        return part.assign(sequence_id=sequence, offset=offset).drop(columns="grp")

    return run


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, tokenizer: str | None = None, keep_ids: bool = False, group_rows: int = 16_000, nodes: int = 2_000) -> DataFrame:
    """A row per piece with its place; `row` tells the rows of one id apart. keep_ids: also the pieces' ids, as little-endian unsigned 32-bit numbers."""
    scratch = Scratch(docs.sparkSession, "packing")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row_key"), F.col(text_col).alias("text"))
    pieces = scratch.save(rows.mapInArrow(lean(_pieces(capacity, end_id, tokenizer, keep_ids)), PIECE_DDL), "pieces", BATCH)
    groups = max(1, round(pieces.count() / group_rows))
    slim = pieces.drop("ids").withColumn("grp", F.pmod(F.xxhash64("id", "row_key", "piece"), F.lit(groups)))
    packed = slim.groupBy("grp").applyInPandas(_pack_group(capacity, nodes), "id long, row_key long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    if keep_ids:
        packed = packed.join(pieces.select("row_key", "piece", "ids"), ["row_key", "piece"])
    return packed.withColumnsRenamed({"id": id_col, "row_key": "row"})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`op2_best_fit_packing`: all documents in sequences of at most 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"))
