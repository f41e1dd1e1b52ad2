"""Packing documents into training windows by sum-of-squares online bin packing."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame

#: Letters below U+0180 once lower-cased, texts beyond that, and separators that Python alone takes for space.
LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff\u0101-\u017f"
PIECES = re.compile(rf"[{LETTERS}]+|[^{LETTERS}\s]\S*")
BEYOND = re.compile("[^\x00-\x1b\x20-\u017f]")
PLAIN = re.compile(r"[^ \t\n\r\x0b\x0c]+")
COLUMNS = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class WordIds(dict):
    """Ids of pieces of text as little-endian uint32 bytes, encoded when first asked for.

    Holds for tokenizers that lower-case, drop white space and part a run of letters from a symbol after it, so
    that a text's ids are its pieces' ids. At most `most` pieces are kept, about 200 bytes each. Latin text is lower-cased first and cut after each run of letters,
    which leaves far fewer pieces; any other text is cut at ASCII white space alone. Special tokens that stand in a text
    are cut out first, as the tokenizer does, and have their own ids.
    """

    def __init__(self, path: str, most: int = 1_200_000):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # for the pieces, which hold none
        self.most = most
        special = {t.content: (k, t) for k, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        if any(t.lstrip or t.rstrip or t.normalized or t.single_word for _, t in special.values()):
            raise ValueError("special tokens that take in or look at the text around them are not handled")
        self.special = {content: struct.pack("<I", k) for content, (k, _) in special.items()}
        self.cuts = re.compile(f"({'|'.join(map(re.escape, sorted(special, key=len, reverse=True)))})") if special else None

    def __missing__(self, piece: str) -> bytes:
        ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        ids = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= self.most:
            self.clear()  # bounds the memory; pieces come back when next met
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self.cuts and self.cuts.search(text):
            return b"".join(self.special[x] if k % 2 else self._plain(x) for k, x in enumerate(self.cuts.split(text)))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, PLAIN.findall(text) if BEYOND.search(text) else PIECES.findall(text.lower())))


def word_ids(path: str) -> WordIds:
    """The process's WordIds for a tokenizer, kept from task to task."""
    import sys
    import types

    held = sys.modules.setdefault("lodeworks_word_ids", types.ModuleType("lodeworks_word_ids")).__dict__
    return held.get(path) or held.setdefault(path, WordIds(path))


class Packer:
    """Sum-of-squares packing: counts[h] windows are filled to level h; an item goes where the sum of the
    squared counts grows least (a new window counts as level 0, a full one costs nothing)."""

    def __init__(self, window: int, first_id: int):
        import numpy as np

        self.np, self.window, self.next = np, window, first_id
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.open: list[list] = [[] for _ in range(window + 1)]  # per level, windows as lists of pieces

    def place(self, doc: int, start: int, size: int) -> list | None:
        """Puts a piece of at most a window into a window; gives the window back if that fills it."""
        np, c = self.np, self.counts
        if size == self.window:
            return [(doc, start, size)]
        before, after = c[: self.window - size + 1], c[size:]
        # the change of the sum of squares when one window moves from level h to h + size
        cost = np.where(before > 0, 2 * (after - before) + 2, np.iinfo(np.int64).max)
        cost[-1] = 1 - 2 * before[-1] if before[-1] else cost[-1]  # it is full and leaves
        cost[0] = 2 * after[0] + 1  # a new window
        h = int(np.argmin(cost))
        held = self.open[h].pop() if h else []
        c[h] -= bool(h)
        held.append((doc, start, size))
        if h + size == self.window:
            return held
        self.open[h + size].append(held)
        c[h + size] += 1
        return None

    def rest(self) -> list[list]:
        """The windows left open, re-cut: their pieces in order fill whole windows, then powers of two."""
        pieces = [p for level in self.open for held in level for p in held]
        left = sum(p[2] for p in pieces)
        sizes = [self.window] * (left // self.window)
        left %= self.window
        sizes += [1 << k for k in range(left.bit_length() - 1, -1, -1) if left >> k & 1]
        out, k, used = [], 0, 0
        for size in sizes:
            held, need = [], size
            while need:
                doc, start, length = pieces[k]
                n = min(need, length - used)
                held.append((doc, start + used, n))
                need -= n
                used += n
                if used == length:
                    k, used = k + 1, 0
            out.append(held)
        return out


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2) -> DataFrame:
    """Pieces of all documents in sequences of at most window tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Online: each task packs the documents of its own input split as they come, so tokens are neither shuffled
    nor kept; a task holds the ids of one document and the open windows' pieces. A document longer than a
    window gives full windows first, and its remainder is placed by the sum-of-squares rule with the counts of
    open windows in an array by level. What is still open at the end of a split is re-cut into full windows
    and sequences of a power of two, so nothing is padded. sequence_id is split * 2**40 + its number there.

    The checksums of pieces cut at the end need their ids: the ids of documents with pieces in open windows are
    kept until those are full, at most one window's worth per open piece.

    Null text counts as empty: the one end id. Equal rows are packed as often as they occur; an empty table
    gives no rows; only doc_id and text are read.
    """

    def run(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        words, end = word_ids(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        packer = Packer(window, 0)
        base = TaskContext.get().partitionId() << 40
        state = {"n": 0, "key": 0}
        kept: dict[int, tuple] = {}  # item number: doc_id, doc_tokens, bytes from, ids
        rows: list[tuple] = []

        def close(held: list, forget: bool = True) -> None:
            offset = 0
            for key, start, size in held:
                doc, tokens, first, ids = kept[key]
                rows.append((doc, start, size, zlib.crc32(ids[(start - first) * 4 : (start - first + size) * 4]), tokens, base + state["n"], offset))
                offset += size
                if forget:
                    del kept[key]
            state["n"] += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in COLUMNS.split(", ")])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = words.encode(text or "") + end
                tokens = len(ids) // 4
                full = tokens // window * window
                for start in range(0, full, window):
                    kept[-1] = (doc, tokens, start, ids[start * 4 : (start + window) * 4])
                    close([(-1, start, window)])
                if full < tokens:
                    state["key"] += 1
                    kept[state["key"]] = (doc, tokens, full, ids[full * 4 :])
                    if held := packer.place(state["key"], full, tokens - full):
                        close(held)
            yield flush()
        for held in packer.rest():
            close(held, forget=False)
        yield flush()

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, COLUMNS)
