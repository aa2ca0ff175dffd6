"""Best-fit packing improved by swap-based local search.

Texts are tokenised whole, each followed by an end id, and cut only if longer than a sequence: then every piece but
the first is full.  Full pieces are sequences of their own.  The others are dealt evenly into groups of up to
``group`` pieces; a group is packed best-fit decreasing, and then improved: pieces of the emptiest bin move to other
bins, or are exchanged one for one or two for one against smaller contents of fuller bins, as long as the sum of the
squared fills grows, until the bin is empty or no exchange helps.  Every bin with room is tried, again after others were
emptied, until the least number of bins is reached or none can be emptied.  Short pieces leave a group about a sequence
over that number; where all pieces are long the search ends with more.

Rows: one per piece.  Null or empty text: the end id alone.  Rows that share a doc_id, or repeat, are packed each.  A
null doc_id is packed like any other.  Equal lengths are taken in the order of doc_id and piece.  Empty table: no rows.
Texts of any length are taken whole.  Further columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .features import ranges
from .shared import chunks, table, tidied, written

_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Texts in which white space meets white space, or that begin or end with it, are encoded whole.
UNEVEN = f"{_WS}{_WS}|^{_WS}|{_WS}$"
#: Below this code point both libraries split text alike in every version; other words go to the tokenizer file itself.
LATIN = "ɐ"
#: Texts in which something else is found are split at spaces first.
OTHER = f"[^\\x{{0}}-\\x{{{ord(LATIN) - 1:X}}}]|<\\|"


class Encoder:
    """Ids of whole texts under a byte-level BPE file of tokenizers.

    Latin texts are encoded whole.  Of others each distinct word of a batch is encoded once: a space between two other
    characters always begins a new pre-token, so a text's ids are those of its first word and of each later word with
    its space.
    """

    def __init__(self, path: str, ranks_path: str, pattern: str, cache: int = 200_000):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(ranks_path, "rb"))}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, np.ndarray] = {}
        self.cache = cache

    def one(self, text: str) -> list[int]:
        if "<|" not in text and (text.isascii() or max(text) < LATIN):
            return self.fast.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids

    def word(self, text: str) -> np.ndarray:
        if (got := self.known.get(text)) is None:
            if len(self.known) >= self.cache:
                self.known.clear()
            got = self.known[text] = np.array(self.one(text), np.uint32)
        return got

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "").take(pa.array(np.arange(len(texts))))
        latin = ~pc.match_substring_regex(texts, OTHER).to_numpy(zero_copy_only=False)
        uneven = pc.match_substring_regex(texts, UNEVEN).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for i in np.flatnonzero(latin).tolist():
            out[i] = np.array(self.fast.encode_ordinary(texts[i].as_py()), np.uint32)
        for i in np.flatnonzero(uneven & ~latin).tolist():
            out[i] = np.array(self.one(texts[i].as_py()), np.uint32)
        even = np.flatnonzero(~uneven & ~latin)
        if not len(even):
            return out
        split = pc.split_pattern(texts.take(pa.array(even)), pattern=" ")
        cuts = split.offsets.to_numpy().astype(np.int64)
        coded = split.values.dictionary_encode()
        words = coded.dictionary.to_pylist()
        code = coded.indices.to_numpy().astype(np.int64) + len(words)
        code[cuts[:-1][np.diff(cuts) > 0]] -= len(words)  # a text's first word has no space before it
        used, code = np.unique(code, return_inverse=True)
        ids = [self.word(words[c] if c < len(words) else " " + words[c - len(words)]) for c in used.tolist()]
        sizes = np.array([len(x) for x in ids])
        flat, starts = np.concatenate(ids), np.concatenate([[0], np.cumsum(sizes)])[:-1]
        whole = flat[ranges(starts[code], sizes[code])]
        ends = np.concatenate([[0], np.cumsum(sizes[code])])[cuts]
        for j, i in enumerate(even.tolist()):
            out[i] = whole[ends[j] : ends[j + 1]]
        return out


def public_encoder() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, size: int, end: int, paths: tuple[str, str, str]) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(*paths)
        for batch in chunks(batches, "text", 2 << 20):
            rows: list[tuple] = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text")), strict=True):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                cuts = [0, *range(len(ids) % size or min(size, len(ids)), len(ids) + 1, size)]
                rows += [(doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidied(work), PIECES)


class Bins:
    """Contents of a group's bins, as lists of item numbers."""

    def __init__(self, lengths: np.ndarray, size: int):
        self.lengths, self.size = lengths, size
        self.bin = np.full(len(lengths), -1)
        self.fill: list[int] = []
        self.best_fit()

    def best_fit(self) -> None:
        """Best-fit decreasing: each item goes to the open bin with the least room that holds it."""
        by_room: dict[int, list[int]] = {}
        rooms = np.zeros(self.size + 1, bool)  # rooms that some bin has
        for item in np.argsort(-self.lengths, kind="stable").tolist():
            n = int(self.lengths[item])
            at = int(rooms[n:].argmax()) + n
            if rooms[at]:
                b = by_room[at].pop()
                rooms[at] = bool(by_room[at])
            else:
                b, at = len(self.fill), self.size
                self.fill.append(0)
            self.bin[item] = b
            self.fill[b] += n
            if at > n:
                by_room.setdefault(at - n, []).append(b)
                rooms[at - n] = True

    def improve(self) -> None:
        """Local search from the emptiest bins until the least number of bins is reached or no bin can be emptied.

        Every bin with room is tried in each pass; a pass that emptied one is followed by another.
        """
        least, used = -(-int(self.lengths.sum()) // self.size), sum(f > 0 for f in self.fill)
        if used <= least:
            return
        self._open()
        while True:
            before = used
            for victim in sorted((b for b, f in enumerate(self.fill) if 0 < f < self.size), key=self.fill.__getitem__):
                if 0 < self.fill[victim] < self.size:
                    self._empty(victim)
                    used -= self.fill[victim] == 0
                    if used <= least:
                        return
            if used == before:
                return

    def _open(self) -> None:
        """Lookups over the bins with room: bins by room, and items by their bin's room and their length."""
        self.items: list[list[int]] = [[] for _ in self.fill]
        for item, b in enumerate(self.bin.tolist()):
            self.items[b].append(item)
        self.by_room: list[set[int]] = [set() for _ in range(self.size)]
        self.at: dict[tuple[int, int], set[int]] = {}
        self.next = np.full((self.size, self.size + 1), self.size, np.int32)  # [room, x]: the least length from x on
        self.rooms = np.zeros(self.size, bool)
        for b in range(len(self.fill)):
            self._enter(b, False)
        for r in np.flatnonzero(self.rooms).tolist():
            self._row(r)

    def _row(self, room: int) -> None:
        row = np.full(self.size + 1, self.size, np.int32)
        there = list({int(self.lengths[i]) for b in self.by_room[room] for i in self.items[b]})
        row[there] = there
        self.next[room] = np.minimum.accumulate(row[::-1])[::-1]

    def _enter(self, b: int, row: bool = True) -> None:
        room = self.size - self.fill[b]
        if 0 < room < self.size:
            self.by_room[room].add(b)
            self.rooms[room] = True
            for i in self.items[b]:
                n = int(self.lengths[i])
                self.at.setdefault((room, n), set()).add(i)
                if row:
                    part = self.next[room, : n + 1]
                    np.minimum(part, n, out=part)

    def _leave(self, b: int) -> None:
        room = self.size - self.fill[b]
        if 0 < room < self.size:
            self.by_room[room].discard(b)
            self.rooms[room] = bool(self.by_room[room])
            for i in self.items[b]:
                n = int(self.lengths[i])
                have = self.at[room, n]
                have.discard(i)
                if not have:  # the lengths up to n, down to the next shorter one, now lead to the next longer one
                    row = self.next[room]
                    row[: n + 1][row[: n + 1] == n] = row[n + 1]

    def _change(self, b: int, gone: list[int], come: list[int]) -> None:
        """Items leave and enter a bin that is not in the lookups."""
        self.items[b] = [i for i in self.items[b] if i not in gone] + come
        self.bin[come] = b
        self.fill[b] += int(self.lengths[come].sum()) - int(self.lengths[gone].sum())

    def _empty(self, victim: int) -> None:
        """Moves and exchanges between the victim and fuller bins, each with a gain, until it is empty or none is left."""
        self._leave(victim)
        while mine := self.items[victim]:
            own = self.fill[victim]
            rooms = np.flatnonzero(self.rooms[: self.size - own + 1])  # of the bins at least as full
            if not len(rooms):
                break
            sizes = self.lengths[mine]
            # move: the item that leaves a bin fullest
            near = np.searchsorted(rooms, sizes)
            gap = np.where(near < len(rooms), rooms[np.minimum(near, len(rooms) - 1)] - sizes, self.size)
            if gap.min() < self.size:
                i = int(gap.argmin())
                b = min(self.by_room[int(rooms[near[i]])])
                give, take = [mine[i]], []
            else:
                # exchange one for one, or two for one: the largest gain that fits
                lengths = np.flatnonzero(counts := np.bincount(sizes))
                a, b = np.triu_indices(len(lengths))
                pairs = (lengths[a] + lengths[b])[(a != b) | (counts[lengths[a]] > 1)]
                sums = np.unique(np.concatenate([lengths, pairs]))
                theirs = self.next[rooms[None, :], np.maximum(sums[:, None] - rooms[None, :], 0)].astype(np.int64)
                more = sums[:, None] - theirs
                gain = np.where(more > 0, more * (self.size - rooms[None, :] - own + more), 0)
                if gain.max() <= 0:
                    break
                i, j = np.unravel_index(int(gain.argmax()), gain.shape)
                give, take = self._making(mine, int(sums[i])), [min(self.at[int(rooms[j]), int(theirs[i, j])])]
                b = int(self.bin[take[0]])
            self._leave(b)
            self._change(b, take, give)
            self._change(victim, give, take)
            self._enter(b)
        self._enter(victim)

    def _making(self, mine: list[int], total: int) -> list[int]:
        """One item of that length, or else two that add up to it."""
        for i in mine:
            if int(self.lengths[i]) == total:
                return [i]
        seen: dict[int, int] = {}
        for i in mine:
            if (other := seen.get(total - int(self.lengths[i]))) is not None:
                return [other, i]
            seen[int(self.lengths[i])] = i
        raise ValueError("no items make that length")


def pack(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item; bins are numbered from 0."""
    full = lengths >= size
    bins = Bins(lengths[~full], size)
    bins.improve()
    out = np.empty(len(lengths), np.int64)
    _, out[~full] = np.unique(bins.bin, return_inverse=True)
    out[full] = (out[~full].max() + 1 if (~full).any() else 0) + np.arange(full.sum())
    order = np.argsort(out, kind="stable")
    before = np.cumsum(lengths[order]) - lengths[order]
    first = np.concatenate([[True], out[order][1:] != out[order][:-1]]) if len(out) else np.zeros(0, bool)
    offset = np.empty(len(lengths), np.int64)
    offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
    return out, offset


def best_fit_packing(docs: DataFrame, size: int = 2048, end: int = 0, paths: tuple[str, str, str] | None = None, group: int = 50_000, least_group: int = 512, least_groups: int = 32) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    rows = written(pieces(docs, size, end, paths or public_encoder()), "pieces")
    n = rows.count()
    groups = max(1, min(-(-n // least_group), max(least_groups, -(-n // group))))
    dealt = rows.withColumn("group", F.pmod(F.monotonically_increasing_id() + F.shiftrightunsigned(F.monotonically_increasing_id(), 33) * 7, F.lit(groups)))

    def work(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, offset = pack(t.column("length").to_numpy(), size)
        number = bins + (t.column("group")[0].as_py() << 40 if t.num_rows else 0)
        return t.drop_columns(["group"]).append_column("sequence_id", pa.array(number, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return dealt.groupBy("group").applyInArrow(work, PIECES + ", sequence_id long, offset long")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))
