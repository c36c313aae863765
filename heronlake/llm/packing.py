"""Packing of tokenised texts into sequences by dot-product vector bin packing.

Every text is tokenised and ends with a closing id. Full-length pieces are cut off at once
and are sequences of their own; what is left of each text is an item with a size in three
dimensions: tokens, segments and loss-bearing tokens. Items wait in a pool of bounded
size. A sequence takes, again and again, the item whose size vector has the largest dot
product with the room left, among those that fit in all dimensions; when none fits, one
waiting item is cut so that its first part fills the sequence. A task's last tokens, too few
for a whole sequence, fill sequences of falling powers of two. So nothing is padded unless
the limit on segments or on loss closes a sequence early, however small the partitions are.
A text never leaves the task that reads it: no shuffle, and a task that is run again gives
the same rows.

Defined cases: null text counts as empty and gives the closing id alone. Null doc_ids are
carried; rows that repeat a doc_id, or a whole row, are packed each on its own, and their
pieces can be told apart by sequence and offset only. An empty table gives no rows. Texts of
any length are tokenised in parts of about 4 MB, cut at white space (a longer piece without
white space is tokenised at once), and cut as they come. Columns other than those named in
the call are ignored, whatever their names are. A null or negative prompt counts as 0, a
prompt beyond the text as its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.llm import worker
from heronlake.llm.token_counts import byte_symbols

#: Items that wait in a task; more only while they are fewer tokens than a sequence holds.
POOL = 1024

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"

#: Bytes and rows of a slice, as multiples of the other operators': the more text at once, the fewer pieces are looked up.
MORE = 4

#: Bytes that what is remembered would take as Python's objects; as arrays it takes about a quarter.
MEMORY = 3 * worker.MEMORY

#: ASCII signs that are never part of a word; the apostrophe may begin an English contraction.
_SIGNS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_ASCII_WORD = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_PROBES = ("word", "Words.", "THE", "naïve", "Ünïcode,", "Œuvre!?", "straße", "a", "éé:;", "ÿŝž|", "b$$$", "c-_", "d)]}\"", "e&*%", "f<|", "g@`~^", "h\\/+=", "(x)", "a.b", "ž...1,2")
_BYTE_LETTERS = {b: c for c, b in byte_symbols().items()}


def _among(signs: bytes) -> np.ndarray:
    """Which of the 256 bytes are among `signs`."""
    found = np.zeros(256, bool)
    found[list(signs)] = True
    return found


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _taken(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of `ids` one after the other."""
    stops = np.cumsum(sizes, dtype=np.int64)
    at = np.repeat((starts - (stops - sizes)).astype(np.int32), sizes)
    at += np.arange(len(at), dtype=np.int32)
    return ids[at]


class Table:
    """Pieces and their ids, as arrays."""

    def __init__(self, pieces: pa.Array, ids: np.ndarray, sizes: np.ndarray):
        self.pieces, self.ids, self.sizes = pieces, ids, sizes
        self.starts = (np.cumsum(sizes, dtype=np.int64) - sizes).astype(np.int32)

    @classmethod
    def of(cls, pieces: list[bytes], values: list[bytes]) -> Table:
        return cls(pa.array(pieces, pa.binary()), np.frombuffer(b"".join(values), "<u4"), np.array([len(x) // 4 for x in values], np.int32))

    def __len__(self) -> int:
        return len(self.sizes)

    def items(self) -> Iterator[tuple[bytes, bytes]]:
        for piece, at, n in zip(self.pieces.to_pylist(), self.starts.tolist(), self.sizes.tolist(), strict=True):
            yield piece, self.ids[at : at + n].tobytes()

    def find(self, pieces: pa.Array) -> np.ndarray:
        """The place of each piece, -1 where it is none of these."""
        return pc.fill_null(pc.index_in(pieces, value_set=self.pieces), -1).to_numpy()

    def take(self, at: np.ndarray) -> Table:
        return Table(self.pieces.take(pa.array(at)), _taken(self.ids, self.starts[at], self.sizes[at]), self.sizes[at])

    def joined(self, other: Table) -> Table:
        return Table(pa.concat_arrays([self.pieces, other.pieces]), np.concatenate([self.ids, other.ids]), np.concatenate([self.sizes, other.sizes]))


class Known:
    """What worker.Remembered does, for ids of pieces and in arrays: many pieces are looked up at once."""

    def __init__(self, memory: int):
        self.half, self.held = memory // 2, 0
        self.young = self.old = Table.of([], [])

    def _add(self, added: Table, whole: Table) -> None:
        """`whole`: the young ones and those."""
        lengths = pc.binary_length(added.pieces).to_numpy()
        if len(added) and lengths.max() > worker.LONGEST:
            added, whole = added.take(np.flatnonzero(lengths <= worker.LONGEST)), None
            lengths = pc.binary_length(added.pieces).to_numpy()
        cost = int(lengths.sum(dtype=np.int64)) + 4 * len(added.ids) + (33 + worker.ENTRY) * len(added)
        if self.held + cost > self.half:
            self.young, self.old, self.held = Table.of([], []), self.young, 0
            whole = added
        if cost <= self.half:
            self.young = self.young.joined(added) if whole is None else whole
            self.held += cost

    def lookup(self, pieces: pa.Array, learn: Callable[[list[bytes]], dict[bytes, bytes]]) -> tuple[Table, np.ndarray]:
        """A table with all pieces, which differ, and each one's place there; `learn` gives the ids of those that aren't known."""
        table, at = self.young, self.young.find(pieces).copy()
        new = np.flatnonzero(at < 0)
        if len(new):
            before = self.old.find(pieces.take(pa.array(new)))
            again, fresh = new[before >= 0], new[before < 0]
            asked = pieces.take(pa.array(fresh)).to_pylist()
            added = self.old.take(before[before >= 0]).joined(Table.of(asked, list(map(learn(asked).__getitem__, asked))))
            at[np.append(again, fresh)] = np.arange(len(table), len(table) + len(added))
            table = table.joined(added)
            self._add(added, table)
        return table, at


class WordEncoder:
    """Ids of whole texts, by remembered ids of the pieces between ASCII white space, and between words and signs.

    The vocabulary's normaliser and splitter never reach across white space, nor from a Latin letter or a digit to an
    ASCII sign, so a text's ids are those of its pieces one after the other. Each distinct piece of some MB of text is
    looked up once. What is remembered is bounded in bytes.
    """

    def __init__(self, path: str, memory: int = MEMORY):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.known = Known(memory)
        mark = self.tokenizer.encode("\x01", add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        # the model alone, for words between spaces; each word's last id has the vocabulary's mark of a word's end
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab, end = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.last[[i for t, i in vocab.items() if end and t.endswith(end)]] = True
        # a sign at which an added token could be torn is no boundary
        self.added = added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        torn = {c for t in added for pair in zip(t, t[1:], strict=False) if any(x in _ASCII_WORD or x > 127 for x in pair) for c in pair}
        self.signs, self.ascii_word = _among(bytes(c for c in _SIGNS if c not in torn)), _among(_ASCII_WORD)
        # the short way is taken only if it agrees with the whole tokenizer on these
        probes = [w.encode() for w in _PROBES]
        self.latin = bool(end) and not any(t.decode().isalnum() for t in added)
        if self.latin:
            found, self.known = self._encode(probes), Known(memory)
            self.latin = found == self._fresh(probes)

    def _fresh(self, words: list[bytes]) -> list[bytes]:
        """Ids of pieces: of many at once between marks, where no piece holds the mark."""
        if self.mark is None or any(b"\x01" in w for w in words):
            found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
            return [np.array(e.ids, "<u4").tobytes() for e in found]
        text = b" \x01 ".join(words).decode()
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = np.append(np.flatnonzero(ids == self.mark), len(ids)).tolist()
        data, out, last = ids.tobytes(), [], 0
        for end in ends:
            out.append(data[4 * last : 4 * end])
            last = end + 1
        return out

    def _plain(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of the pieces of Latin letters alone, from the vocabulary's model, many at once.

        For these the normaliser only lower-cases and the splitter leaves them whole.
        """
        out, asked = {}, {}
        lower = b"\n".join(pieces).decode().lower().split("\n")  # no piece holds a line feed
        for piece, word in zip(pieces, lower, strict=True):
            if not word.isalpha():
                continue
            if word.isascii():
                asked.setdefault(word, []).append(piece)
            elif max(word) < "\u0180":
                asked.setdefault(word.encode().decode("latin-1").translate(_BYTE_LETTERS), []).append(piece)
        words = list(asked)
        for at in range(0, len(words), 4000):
            part = words[at : at + 4000]
            ids = np.array(self.model.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
            if len(ends) != len(part):
                continue  # a sign that the model doesn't know: left to the whole tokenizer
            data, last = ids.tobytes(), 0
            for word, end in zip(part, ends, strict=True):
                found, last = data[last:end], end
                for piece in asked[word]:
                    out[piece] = found
        return out

    def _learn(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        found = self._plain(pieces) if self.latin and pieces else {}
        other = [w for w in pieces if w not in found]
        for at in range(0, len(other), 1000):
            part = other[at : at + 1000]
            found.update(zip(part, self._fresh(part), strict=True))
        return found

    def _parted(self, text: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same texts with a space between a word and a sign that touch, and most of A-Z in lower case.

        `ends`: 0 and where each text ends. A letter before a byte that may begin a combining mark stays as it is, as the
        normaliser composes before it lower-cases.
        """
        data = np.frombuffer(text, np.uint8)
        if not self.latin or len(data) < 2:
            return data, ends
        small = text.lower()
        if not any(t.lower() in small for t in self.added):
            bare = np.append((data[1:] < 0x80) | (data[1:] >= 0xC3) & (data[1:] <= 0xC5), True)
            data = np.where(bare, np.frombuffer(small, np.uint8), data)
        one, two = data[:-1], data[1:]
        sign, word = self.signs[data], self.ascii_word[data]
        closes = word.copy()
        # of two bytes, U+00C0 to U+017F: letters, but for the signs U+00D7 and U+00F7 and for U+0130, which becomes two characters
        closes[1:] |= (one >= 0xC3) & (one <= 0xC5) & ~((one == 0xC3) & ((two == 0x97) | (two == 0xB7))) & ~((one == 0xC4) & (two == 0xB0))
        at = np.flatnonzero((closes[:-1] & sign[1:]) | (sign[:-1] & word[1:])) + 1
        return np.insert(data, at, 32), ends + np.searchsorted(at, ends)

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        data, ends = self._parted(b"".join(texts), np.cumsum([0, *map(len, texts)]))
        whole = pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))
        split = pc.ascii_split_whitespace(whole)
        coded = split.flatten().dictionary_encode()
        table, at = self.known.lookup(coded.dictionary.cast(pa.binary()), self._learn)
        at = at[coded.indices.to_numpy()]
        sizes = table.sizes[at]
        out = _taken(table.ids, table.starts[at], sizes).tobytes()
        cuts = (4 * np.append(0, np.cumsum(sizes, dtype=np.int64))[split.offsets.to_numpy()]).tolist()
        return [out[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if sum(map(len, texts)) <= 2 * MORE * worker.SIZE:
            return self._encode(texts)
        return [b"".join(self._encode([part])[0] for part in worker.parts(t, MORE * worker.SIZE)) for t in texts]


class Packer:
    """Fills sequences from a pool of items; `add` and `flush` return finished pieces."""

    def __init__(self, capacity: int, max_segments: int, max_loss: int, first_sequence: int):
        self.room = np.array([capacity, max_segments, max_loss], np.int64)
        self.scale = 1.0 / self.room
        self.sequence, self.tokens = first_sequence, 0
        self.items: list[tuple] = []  # (doc_id, start, prompt left, ids, doc_tokens)
        self.rows: list[tuple] = []

    def _loss(self, item: tuple) -> int:
        return max(0, len(item[3]) // 4 - item[2])

    def _put(self, item: tuple, offset: int) -> None:
        doc, start, _, ids, total = item
        self.rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, self.sequence, offset, self._loss(item)))

    def _cut(self, item: tuple, n: int) -> tuple[tuple, tuple]:
        doc, start, prompt, ids, total = item
        return (doc, start, prompt, ids[: 4 * n], total), (doc, start + n, max(0, prompt - n), ids[4 * n :], total)

    def _most(self, item: tuple, left: np.ndarray) -> int:
        """Tokens of `item`, from its start, that still fit."""
        return 0 if left[1] < 1 else int(min(left[0], item[2] + left[2], len(item[3]) // 4))

    def add(self, item: tuple) -> None:
        while len(item[3]) // 4 >= self.room[0] or self._loss(item) >= self.room[2]:
            head, item = self._cut(item, self._most(item, self.room))
            self._put(head, 0)
            self.sequence += 1
        if item[3]:
            self.items.append(item)
            self.tokens += len(item[3]) // 4
        if len(self.items) >= POOL and self.tokens >= 2 * self.room[0]:
            self.fill(POOL // 2)

    def fill(self, keep: int) -> None:
        """Finish sequences until at most `keep` items wait, or fewer tokens than a sequence holds."""
        sizes = np.array([(len(x[3]) // 4, 1, self._loss(x)) for x in self.items], np.int64).reshape(-1, 3)
        free = np.ones(len(self.items), bool)
        while free.sum() > keep and self.tokens >= self.room[0]:
            self._sequence(sizes, free, self.room)
        self.items = [x for x, f in zip(self.items, free, strict=True) if f]

    def flush(self) -> None:
        """Finish all sequences. The last tokens, too few for a whole sequence, make sequences of falling powers of
        two, so that none of them is padded unless the limits on segments or loss close it early."""
        self.fill(0)
        while self.items:
            sizes = np.array([(len(x[3]) // 4, 1, self._loss(x)) for x in self.items], np.int64).reshape(-1, 3)
            free = np.ones(len(self.items), bool)
            room = self.room.copy()
            room[0] = min(room[0], 1 << (self.tokens.bit_length() - 1))
            self._sequence(sizes, free, room)
            self.items = [x for x, f in zip(self.items, free, strict=True) if f]

    def _sequence(self, size: np.ndarray, free: np.ndarray, room: np.ndarray) -> None:
        """Fill one sequence from the waiting items that are `free`."""
        items, left, offset = self.items, room.copy(), 0
        while left[0]:
            fits = free & (size <= left).all(axis=1)
            if fits.any():
                at = int(np.argmax(np.where(fits, (size * self.scale) @ (left * self.scale), -1.0)))
                item, free[at] = items[at], False
            else:
                if not free.any():
                    break
                at = int(np.argmax(np.where(free, size[:, 0], -1)))
                n = self._most(items[at], left)
                if n < 1:
                    break
                item, items[at] = self._cut(items[at], n)
                size[at] = (len(items[at][3]) // 4, 1, self._loss(items[at]))
            self._put(item, offset)
            n = len(item[3]) // 4
            left -= (n, 1, self._loss(item))
            offset += n
            self.tokens -= n
        self.sequence += 1

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def _pack(path: str, end_id: int, capacity: int, max_segments: int, max_loss: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = worker.owned("packing", (path,), lambda: WordEncoder(path)), np.array([end_id], "<u4").tobytes()
        packer = Packer(capacity, max_segments, max_loss, TaskContext.get().partitionId() << 40)
        schema = pa.schema([(f.split()[0], pa.int64()) for f in SCHEMA.split(", ")])

        def out() -> pa.RecordBatch:
            rows = packer.taken()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 8)], schema=schema)

        for batch in worker.slices(batches, MORE * worker.ROWS, MORE * worker.SIZE):
            asked, ids = encoder.encode(worker.texts(batch, "ask")), encoder.encode(worker.texts(batch))
            for doc, prompt, a, x in zip(batch.column("doc_id").to_pylist(), batch.column("prompt").to_pylist(), asked, ids, strict=True):
                packer.add((doc, 0, max(0, prompt or 0) + len(a) // 4, a + x + end, (len(a) + len(x)) // 4 + 1))
            if len(packer.rows) >= 5000:
                yield out()
        packer.flush()
        yield out()
        worker.give_back()

    return run


def pack(
    docs: DataFrame, path: str | None = None, end_id: int = 1, capacity: int = 2048, max_segments: int | None = None,
    max_loss: int | None = None, prompt_col: str | None = None, ask_col: str | None = None,
) -> DataFrame:
    """One row per piece: its document and place there, its ids' CRC-32, its sequence and place there.

    `max_segments` and `max_loss` are as wide as `capacity` unless they are given. `prompt_col`: number of a text's
    leading tokens that bear no loss. `ask_col`: text whose ids come before the text's and bear no loss.
    """
    prompt = F.col(prompt_col).cast("long") if prompt_col else F.lit(None).cast("long")
    ask = F.col(ask_col).cast("string") if ask_col else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), prompt.alias("prompt"), ask.alias("ask"))
    return rows.mapInArrow(_pack(path or vocabulary_path(), end_id, capacity, max_segments or capacity, max_loss or capacity), SCHEMA)
