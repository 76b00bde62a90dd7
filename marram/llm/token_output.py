"""Token-ID output (operator 10): Simple-8b word-aligned blocks in binary files, written and read by Spark's own sinks and sources.

Each document's ids are packed where its text lies, into 64-bit words of its own; only packed words are dealt, by ranges of
doc_id whose bounds come from quantiles. A file
is blocks one after another, each ended by the eight bytes END. A block (little-endian):
  8 bytes   u32 MAGIC, u32 mask: a byte by which all that follows is XORed, chosen so that END occurs in no block
  header    u32 entries, ids, words, escapes, then u64 start (ids of the file before this block), u64 open (ids of the first
            entry's document in earlier blocks)
  entries   i64 doc_id, u32 ids, words, flags (1: the document ends here; 2: doc_id is null), 0
  escapes   u32 position among the block's ids, u32 0, u64 value: ids too large for a word, coded as 0
  words     u64 each: selector in the top 4 bits, then as many ids as it says, first id in the lowest bits
The entries make every document addressable without decoding, and decoding takes one numpy step for each selector in use. The
reader takes blocks as the records of a splittable text source, so no task holds a file. A document longer than a block goes
on in the next one of the same file; other documents lie within one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANKS, Words, Workspace, bounded_batches, buffers, checked_broadcast, word_hashes

# Ids in a word, and bits for each, by selector.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
MAGIC, END = 0x42385332, b"\nS8BEND\n"
#: Ids of a block, at most.
BLOCK_IDS = 1 << 16
#: Bytes that a worker remembers words and their ids in, over two generations.
CACHE_BYTES = 24 << 20
#: Text of a file: the session's shuffle partitions are used where each gets LEAST_BYTES, and more for more than FILE_BYTES each.
LEAST_BYTES, FILE_BYTES, MOST_FILES = 16 << 20, 256 << 20, 20_000
_HEAD = np.dtype([("entries", "<u4"), ("ids", "<u4"), ("words", "<u4"), ("escapes", "<u4"), ("start", "<u8"), ("open", "<u8")])
_ENTRY = np.dtype([("doc_id", "<i8"), ("ids", "<u4"), ("words", "<u4"), ("flags", "<u4"), ("zero", "<u4")])
_ESCAPE = np.dtype([("at", "<u4"), ("zero", "<u4"), ("value", "<u8")])
#: The least selector of an id, by its value, of those below 2**16.
_BITS = np.searchsorted(1 << WIDTHS, np.arange(1 << 16), "right").astype(np.uint8)


# ---------------------------------------------------------------- Simple-8b


def pack(ids: np.ndarray, lo: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, where each document's words begin and end, escapes) for unsigned ids of documents ids[lo[d] : lo[d + 1]] (one
    document, if None): each word takes as many of the next ids of its document as fit."""
    v = ids.astype(np.uint64)
    n = len(v)
    lo = np.array([0, n]) if lo is None else lo
    most = int(v.max()) if n else 0
    large = np.flatnonzero(v >> np.uint64(60)) if most >> 60 else np.zeros(0, np.int64)
    escapes = np.zeros(len(large), _ESCAPE)
    escapes["at"], escapes["value"] = large, v[large]
    v[large] = 0
    if not n:
        return np.zeros(0, "<u8"), np.zeros(len(lo), np.int64), escapes
    need = {1: np.zeros(n + 64, np.uint8)}  # ids past the end count as 0 and need no room
    if most < len(_BITS):
        need[1][:n] = _BITS[v]
    else:
        for b in WIDTHS[:-1]:
            need[1][:n] += v >> np.uint64(b) != 0
    for k in (2, 4, 8, 16, 32):
        h = need[k // 2]
        need[k] = h.copy()
        np.maximum(h[: -(k // 2)], h[k // 2 :], out=need[k][: -(k // 2)])
    chosen = np.full(n, len(COUNTS) - 1, np.uint8)
    for s in range(len(COUNTS) - 2, -1, -1):
        c = int(COUNTS[s])
        k = 1 << (c.bit_length() - 1)
        chosen[np.maximum(need[k][:n], need[k][c - k : c - k + n]) <= s] = s
    step, at, upto, i = COUNTS[chosen].tolist(), [], [0], 0
    for end in lo[1:].tolist():
        while i < end:
            at.append(i)
            i += step[i]
        i = end
        upto.append(len(at))
    at = np.array(at)
    sel = chosen[at]
    room = np.minimum(COUNTS[sel], np.repeat(lo[1:], np.diff(upto)) - at)  # a document's last word may have less than it could
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in np.unique(sel):
        k = np.flatnonzero(sel == s)
        w, first, has = np.uint64(WIDTHS[s]), at[k], room[k]
        x = np.zeros(len(k), np.uint64)
        for j in range(int(COUNTS[s])):
            if (has > j).all():
                x |= v[first + j] << (np.uint64(j) * w)
            else:
                y = has > j
                x[y] |= v[first[y] + j] << (np.uint64(j) * w)
        words[k] |= x
    return words, np.array(upto), escapes


def counts_of(words: np.ndarray) -> np.ndarray:
    """Ids that each word has room for."""
    return COUNTS[(words >> np.uint64(60)).astype(np.int64)]


def unpack(words: np.ndarray) -> np.ndarray:
    """All ids of the words, the unused places of a document's last word (0) included."""
    count = counts_of(words)
    at = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    for s in np.unique(sel):
        k = np.flatnonzero(sel == s)
        w, mask = np.uint64(WIDTHS[s]), np.uint64((1 << int(WIDTHS[s])) - 1)
        x = words[k]
        for j in range(int(COUNTS[s])):
            out[at[k] + j] = (x >> (np.uint64(j) * w)) & mask
    return out


Piece = tuple  # (doc_id, ids, words, escapes, ends here), escapes counted from the piece's first id


def block(pieces: list[Piece], start: int, opened: int = 0) -> bytes:
    entries = np.array([(d or 0, n, len(w), done + 2 * (d is None), 0) for d, n, w, _, done in pieces], _ENTRY)
    before = np.cumsum(entries["ids"].astype(np.int64)) - entries["ids"]
    escapes = []
    for b, (_, _, _, e, _) in zip(before.tolist(), pieces, strict=True):
        if len(e):
            e = e.copy()
            e["at"] += b
            escapes.append(e)
    escapes = np.concatenate(escapes) if escapes else np.zeros(0, _ESCAPE)
    words = np.concatenate([p[2] for p in pieces]) if pieces else np.zeros(0, "<u8")
    head = np.array([(len(entries), int(entries["ids"].sum()), len(words), len(escapes), start, opened)], _HEAD)
    body = b"".join(x.tobytes() for x in (head, entries, escapes, words.astype("<u8")))
    mask, out = 0, body
    while END in (whole := np.array([MAGIC, mask], "<u4").tobytes() + out):
        mask += 1
        out = (np.frombuffer(body, np.uint8) ^ np.uint8(mask)).tobytes()
    return whole


def decoded(data: bytes) -> tuple[np.void, np.ndarray, np.ndarray]:
    """(header, entries, ids) of a block; ValueError where its lengths don't add up."""
    magic, mask = np.frombuffer(data, "<u4", 2).tolist() if len(data) >= 8 + _HEAD.itemsize else (0, 0)
    if magic != MAGIC or mask > 255:
        raise ValueError("no block")
    data = (np.frombuffer(data, np.uint8)[8:] ^ np.uint8(mask)).tobytes() if mask else data[8:]
    head = np.frombuffer(data, _HEAD, 1)[0]
    sizes = [_HEAD.itemsize, int(head["entries"]) * _ENTRY.itemsize, int(head["escapes"]) * _ESCAPE.itemsize, int(head["words"]) * 8]
    if sum(sizes) != len(data):
        raise ValueError(f"a block of {len(data)} bytes where its header says {sum(sizes)}")
    at = np.cumsum(sizes)
    entries, escapes = np.frombuffer(data, _ENTRY, int(head["entries"]), at[0]), np.frombuffer(data, _ESCAPE, int(head["escapes"]), at[1])
    words = np.frombuffer(data, "<u8", int(head["words"]), at[2])
    ids, count = unpack(words), counts_of(words)
    if int(entries["ids"].sum()) != len(ids):  # leave out the unused places of last words
        first = np.r_[0, np.cumsum(count)][np.r_[0, np.cumsum(entries["words"].astype(np.int64))[:-1]]] if len(entries) else np.zeros(0, np.int64)
        ids = ids[_flat(first, entries["ids"].astype(np.int64))]
    if len(escapes):
        ids[escapes["at"]] = escapes["value"]
    return head, entries, ids


# ---------------------------------------------------------------- ids of texts


def _flat(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], ..., starts[i] + counts[i] - 1 for each i in turn."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


class Known:
    """Ids of words: arrays sorted by the words' hashes, with the words' own bytes for confirmation."""

    def __init__(self):
        self.h = np.zeros(0, np.uint64)
        self.at, self.n, self.id_at, self.id_n = (np.zeros(0, np.int32) for _ in range(4))
        self.bytes, self.ids = np.zeros(0, np.uint8), np.zeros(0, np.uint32)

    def size(self) -> int:
        return 24 * len(self.h) + len(self.bytes) + 4 * len(self.ids)

    def find(self, h: np.ndarray, data: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Places of the words data[start:start + n] of hashes h, or -1."""
        out = np.full(len(h), -1, np.int64)
        if len(self.h) and len(h):
            k = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
            like = np.flatnonzero((self.h[k] == h) & (self.n[k] == n))
            if len(like):
                k, m = k[like], n[like]
                unlike = data[_flat(starts[like], m)] != self.bytes[_flat(self.at[k].astype(np.int64), m)]
                same = np.add.reduceat(unlike, np.cumsum(m) - m) == 0
                out[like[same]] = k[same]
        return out

    def add(self, h: np.ndarray, words: np.ndarray, n: np.ndarray, ids: np.ndarray, id_n: np.ndarray) -> None:
        """Adds words (bytes, lengths) and their ids; h is in no order. A hash that is known already stays as it is."""
        order = np.argsort(h)
        place = np.searchsorted(self.h, h[order])
        if len(self.h):
            new = self.h[np.minimum(place, len(self.h) - 1)] != h[order]
            order, place = order[new], place[new]
        at, id_at = len(self.bytes) + np.cumsum(n) - n, len(self.ids) + np.cumsum(id_n) - id_n
        self.h = np.insert(self.h, place, h[order])
        self.at, self.n, self.id_at, self.id_n = (np.insert(a, place, b[order]) for a, b in ((self.at, at), (self.n, n), (self.id_at, id_at), (self.id_n, id_n)))
        self.bytes, self.ids = np.concatenate([self.bytes, words]), np.concatenate([self.ids, ids])


_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256)])
_PLAIN = np.isin(np.arange(256), [*range(33, 48), *range(58, 127)]) & (np.arange(256) != 39)


class Encoder:
    """Ids of texts by a tokenizer of the tokenizers library.

    For a tokenizer that drops blanks, no token crosses one, so a text's ids are those of its words in turn; a plain word (Latin
    letters and ASCII signs) is cut further, into the tokenizer's own pre-tokens, which go straight to its model. Each distinct
    word of a run is encoded once, and words are remembered up to `cache_bytes`. Words of other kinds take the whole tokenizer,
    and so do whole texts where the tokenizer keeps blanks or cuts otherwise: both are tried on fixed strings first.
    """

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.cache_bytes = Tokenizer.from_file(path), cache_bytes
        self.model = self.tokenizer.model
        # the model sees each byte as a character; those of these letters' bytes that Latin-1 shows otherwise
        bytewise = ByteLevel(add_prefix_space=False, use_regex=False)
        self.odd = [(chr(b), bytewise.pre_tokenize_str(chr(b + 0x40))[0][0][1]) for b in (*range(0x9F, 0xA1), 0xAD)]
        self.young, self.old = Known(), Known()
        w = self._whole(["Ab cD", "\n ab \tcd ", "ab", "cd", "Ab", "cD"])
        self.blanks_drop = w[0] == w[1] == w[2] + w[3] == w[4] + w[5]
        tries = ["Añb.,Ça(ß)x", "être!?ÀB", "x***$%,íÍ"]
        self.pieces = self.blanks_drop and self._whole(tries) == [[i for p in re.findall(r"[a-zß-öø-ÿ]+|[^a-zß-öø-ÿ]+", t.lower()) for i in self._piece(p)] for t in tries]

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> list[int]:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1")
            for a, b in self.odd:
                piece = piece.replace(a, b)
        return [t.id for t in self.model.tokenize(piece)]

    def _units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends, and whether each is a piece of a plain word."""
        words = Words(data, offsets, BLANKS, hashed=False)
        starts, ends = words.starts, words.ends
        if not self.pieces or not len(starts):
            return starts, ends, np.zeros(len(starts), bool)
        c3 = data == 0xC3
        latin = c3.copy()
        latin[1:] |= c3[:-1] & (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        odd = ~(_PLAIN[data] | latin)
        odd[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)  # "<|" may begin a special token
        upto = np.r_[0, np.cumsum(odd, dtype=np.int32)]
        plain = upto[ends] == upto[starts]
        letter = _LETTER[data]
        change = np.r_[False, letter[1:] != letter[:-1]]
        change[starts] = True
        n = ends - starts
        inside = np.zeros(len(data), bool)
        inside[_flat(starts[plain], n[plain])] = True
        first = change & inside
        first[starts] = True
        first = np.flatnonzero(first)
        of = np.searchsorted(starts, first, "right") - 1  # the word of each unit
        last = np.r_[of[1:] != of[:-1], True]
        return first, np.where(last, ends[of], np.r_[first[1:], 0]), plain[of]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a run one after another, and where each text's begin and end (one more than texts)."""
        if not self.blanks_drop:
            raw, off = data.tobytes(), offsets.tolist()
            each = self._whole([raw[a:b].decode() for a, b in zip(off[:-1], off[1:], strict=True)])
            return np.array([i for x in each for i in x], np.uint32), np.r_[0, np.cumsum([len(x) for x in each])].astype(np.int64)
        starts, ends, plain = self._units(data, offsets)
        h, first, code = np.unique(word_hashes(data, starts, ends, fold=False), return_index=True, return_inverse=True)
        s, n = starts[first], ends[first] - starts[first]
        at, count = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
        known = self.young.find(h, data, s, n)
        left = np.flatnonzero(known < 0)
        at[known >= 0], count[known >= 0] = self.young.id_at[known[known >= 0]], self.young.id_n[known[known >= 0]]
        pool = [self.young.ids]
        if len(left):
            before = self.old.find(h[left], data, s[left], n[left])
            again, new = before >= 0, left[before < 0]
            raw = data.tobytes()
            made: list[list[int] | None] = [self._piece(raw[a : a + m].decode().lower()) if p else None for a, m, p in zip(s[new].tolist(), n[new].tolist(), plain[first[new]].tolist(), strict=True)]
            odd = [i for i, x in enumerate(made) if x is None]
            for i, x in zip(odd, self._whole([raw[a : a + m].decode() for a, m in zip(s[new[odd]].tolist(), n[new[odd]].tolist(), strict=True)] if odd else []), strict=True):
                made[i] = x
            made_n = np.array([len(x) for x in made], np.int64)
            old_at, old_n = self.old.id_at[before[again]].astype(np.int64), self.old.id_n[before[again]].astype(np.int64)
            fresh = np.concatenate([self.old.ids[_flat(old_at, old_n)], np.array([i for x in made for i in x], np.uint32)])
            order, fresh_n = np.r_[left[again], new], np.r_[old_n, made_n]
            at[order], count[order] = len(self.young.ids) + np.cumsum(fresh_n) - fresh_n, fresh_n
            pool.append(fresh)
        pool = np.concatenate(pool)
        if len(left):
            if self.young.size() > self.cache_bytes // 2:
                self.old, self.young = self.young, Known()
            self.young.add(h[order], data[_flat(s[order], n[order])], n[order], fresh, fresh_n)
        per = count[code]
        lo = np.searchsorted(starts, offsets)
        return pool[_flat(at[code], per)], np.r_[0, np.cumsum(per)][lo]


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, cache_bytes: int = CACHE_BYTES) -> Encoder:
    """One for each worker process, its memory bounded by `cache_bytes`."""
    if (path, cache_bytes) not in _encoders:
        _encoders.clear()
        _encoders[path, cache_bytes] = Encoder(path, cache_bytes)
    return _encoders[path, cache_bytes]


_CODED = "doc_id long, n long, tie long, words binary, escapes binary, part int"


def parts(ids: np.ndarray, bounds: np.ndarray, first: int) -> np.ndarray:
    """The range that each id is dealt to: as many bounds are below it. An id that fills several ranges, and is several bounds
    itself, goes to each of them in turn, `first` being the number of rows before."""
    low, high = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
    turn = (first + np.arange(len(ids))) % (high - low + 1)
    return np.where(high - low > 1, low + turn, low).astype(np.int32)


def _coder(path: str, end_id: int | None, cache_bytes: int, bounds: np.ndarray, run_bytes: int = 1 << 20):
    def code(batches):
        rows = 0
        known = encoder(path, cache_bytes)
        end = np.array([] if end_id is None else [end_id], np.uint32)
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            i = 0
            while i < batch.num_rows:
                j = min(batch.num_rows, max(i + 1, int(np.searchsorted(offsets, offsets[i] + run_bytes, "right")) - 1))
                ids, lo = known.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                if len(end):
                    ids, lo = np.insert(ids, lo[1:], end), lo + np.arange(len(lo))
                coded, upto, large = pack(ids, lo)
                raw, bytes_lo = coded.tobytes(), (8 * upto).tolist()
                words = [raw[a:b] for a, b in zip(bytes_lo[:-1], bytes_lo[1:], strict=True)]
                escapes = [b""] * (j - i)
                for d in np.unique(np.searchsorted(lo, large["at"], "right") - 1).tolist():
                    mine = large[(large["at"] >= lo[d]) & (large["at"] < lo[d + 1])].copy()
                    mine["at"] -= lo[d]
                    escapes[d] = mine.tobytes()
                n, tie = np.diff(lo), [zlib.crc32(w) for w in words]
                ids = batch.column(0).slice(i, j - i)
                part = np.where(ids.is_valid().to_numpy(zero_copy_only=False), parts(ids.fill_null(0).to_numpy(), bounds, rows), 0)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(tie, pa.int64()), pa.array(words, pa.binary()), pa.array(escapes, pa.binary()), pa.array(part, pa.int32())], names=["doc_id", "n", "tie", "words", "escapes", "part"])
                rows += j - i
                i = j

    return code


# ---------------------------------------------------------------- files


def _cut(doc_id, n: int, words: np.ndarray, escapes: np.ndarray, most: int) -> Iterator[Piece]:
    """A document's pieces of at most `most` ids, cut between words."""
    if n <= most:
        yield doc_id, n, words, escapes, True
        return
    upto = np.cumsum(counts_of(words))
    w = done = 0
    while w < len(words):
        end = max(w + 1, int(np.searchsorted(upto, done + most, "right")))
        to = min(n, int(upto[end - 1]))
        e = escapes[(escapes["at"] >= done) & (escapes["at"] < to)].copy()
        e["at"] -= done
        yield doc_id, to - done, words[w:end], e, end == len(words)
        w, done = end, to


def _writer(block_ids: int):
    """Over (doc_id, n, words, escapes): blocks."""

    def write(batches):
        pieces, held, start, opened, before = [], 0, 0, 0, 0

        def flush():
            nonlocal pieces, held, start
            out = block(pieces, start, opened)
            start += held
            pieces, held = [], 0
            return out

        for batch in batches:
            done: list[bytes] = []
            for doc_id, n, w, e in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                before = 0
                for piece in _cut(doc_id, n, np.frombuffer(w, "<u8"), np.frombuffer(e, _ESCAPE), block_ids):
                    if pieces and (held + piece[1] > block_ids or len(pieces) >= block_ids):
                        done.append(flush())
                    if not pieces:
                        opened = before
                    pieces.append(piece)
                    held += piece[1]
                    before += piece[1]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(done, pa.binary())], names=["block"])
        if pieces:
            yield pa.RecordBatch.from_arrays([pa.array([flush()], pa.binary())], names=["block"])

    return write


def write_token_files(docs: DataFrame, out: str, tokenizer: str, *, end_id: int | None = 2, block_ids: int = BLOCK_IDS, cache_bytes: int = CACHE_BYTES, least_bytes: int = LEAST_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Encodes whole texts (null: empty) and writes them to files under `out`, in ascending doc_id order over the files in name
    order (null first). Rows that share an id are ordered by a checksum of their ids within a file, and fill several files where
    they are many. Texts are encoded and packed where they lie, and the packed words dealt by ranges of doc_id. Spark's committer
    makes a retried task's file the only one. An empty table gives no blocks."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(MOST_FILES, max(1, -(-size // file_bytes), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // least_bytes))))
    bounds = (rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], max(10_000, 10 * n))).first()[0] or []) if n > 1 else []
    coded = rows.mapInArrow(_coder(tokenizer, end_id, cache_bytes, np.array(sorted(bounds), np.int64)), _CODED)
    dealt = coded.repartitionById(n, "part").sortWithinPartitions("doc_id", "tie").select("doc_id", "n", "words", "escapes")
    blocks = dealt.mapInArrow(_writer(block_ids), "block binary")
    blocks.select(F.col("block").cast("string")).write.option("lineSep", END.decode()).text(out)  # the sink writes bytes as they are


_ROWS = "file long, doc_id long, at long, n_tokens long, ids_crc32 long, piece long"


def _reader(batches):
    """Over (file, block): a row for each entry; `piece` is null for a whole document, else the ids of it in earlier entries."""
    for batch in batches:
        rows = []
        for file, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            head, entries, ids = decoded(data.as_py())
            raw, at, before, low = ids.astype("<u4").tobytes(), int(head["start"]), int(head["open"]), 0
            for doc_id, n, _, flags, _ in entries.tolist():
                crc = zlib.crc32(raw[4 * low : 4 * (low + n)])
                rows.append((file, None if flags & 2 else doc_id, at + low - before, n, crc, before if before or not flags & 1 else None))
                low, before = low + n, 0
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["file", "doc_id", "at", "n_tokens", "ids_crc32", "piece"])


def _times(m: list[int], v: int) -> int:
    out = 0
    for k in range(32):
        if v >> k & 1:
            out ^= m[k]
    return out


def crc32_of_both(a: int, b: int, n: int) -> int:
    """The crc32 of two runs of bytes, the second n long, from those of each: a is advanced over n zero bytes, by squaring."""
    m = [0xEDB88320, *(1 << k for k in range(31))]  # over one zero bit
    for _ in range(3):
        m = [_times(m, x) for x in m]
    while n:
        if n & 1:
            a = _times(m, a)
        n >>= 1
        if n:
            m = [_times(m, x) for x in m]
    return a ^ b


def _joined(batches):
    """Over (file, at, doc_id, pieces: sorted (piece, n, crc)): the rows of documents that go over several blocks."""
    for batch in batches:
        rows = []
        for file, at, doc_id, pieces in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            n = crc = 0
            for p in pieces:
                n, crc = n + p["n"], crc32_of_both(crc, p["crc"], 4 * p["n"])
            rows.append((file, doc_id, at, n, crc))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["file", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_token_files(spark: SparkSession, path: str, ws: Workspace | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the files; start counts the ids of all files before.
    Blocks are records of the text source, which cuts files into splits between them."""
    ws = ws or Workspace(spark, "tokens")
    raw = spark.read.option("lineSep", END.decode()).option("pathGlobFilter", "part-*").text(path)
    file = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    rows = ws.stage(raw.select(file.alias("file"), F.col("value").cast("binary").alias("block")).mapInArrow(_reader, _ROWS), "read")
    pieces = F.sort_array(F.collect_list(F.struct("piece", F.col("n_tokens").alias("n"), F.col("ids_crc32").alias("crc"))))  # one for each block of a document
    long = rows.where("piece is not null").groupBy("file", "at").agg(F.first("doc_id").alias("doc_id"), pieces.alias("pieces"))
    long = long.mapInArrow(_joined, "file long, doc_id long, at long, n_tokens long, ids_crc32 long")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))  # one row for each file
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    every = rows.where("piece is null").drop("piece").unionByName(long)
    return every.join(checked_broadcast(files, 16), "file").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_output(spark: SparkSession, docs: DataFrame, tokenizer: str, *, end_id: int | None = 2, block_ids: int = BLOCK_IDS, cache_bytes: int = CACHE_BYTES, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes docs as token files in the shared folder and reads them back: one row for each row of docs (see the functions above)."""
    bounded_batches(spark)
    ws = Workspace(spark, "tokens")
    write_token_files(docs, path := ws.path("files"), tokenizer, end_id=end_id, block_ids=block_ids, cache_bytes=cache_bytes, least_bytes=least_bytes)
    return read_token_files(spark, path, ws)
