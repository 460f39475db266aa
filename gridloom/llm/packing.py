"""Packing token sequences by Karmarkar-Karp multiway differencing (operator 9).

Documents are tokenised and dealt to groups of about ``group_tokens`` tokens by row.  In a group every
full window of a document is a sequence of its own; the remainders are packed by differencing: each
starts as a partial partition with one loaded window, and the two partial partitions of greatest
spread are merged, heaviest window against lightest, until one is left.  The windows are then nearly
equal.  Whenever one exceeds the capacity the window count rises and all is differenced anew, until none does.

Two or three remainders a window can't be levelled by any partition, and the count would rise far.  So, as documents may
be cut, the shortest remainders (``FILLER`` of the tokens) are cut small before, to fill what the others leave.

Defined results.  Null text is empty: one piece holding the end id.  Rows whose doc_id is null are packed
with a null doc_id.  Repeated rows are packed as often as they occur; an empty table gives an empty
result; other columns are ignored.  Ties in spread go to the earlier partial partition.
"""

from __future__ import annotations

import bisect
import heapq
import json
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from .common import byte_slices, slices, with_row

CAPACITY = 2048
END_ID = 1
GROUP_TOKENS = 1 << 20
#: Pieces of words whose ids a worker remembers (and as many older ones), and the letters of the longest such.
REMEMBERED, LONG = 150_000, 64
#: Bytes of texts whose words are looked up together (one text at least), and words whose ids are laid out together.
BYTES_AT_ONCE, WORDS_AT_ONCE = 1 << 23, 1 << 20
#: Part of the remainders' tokens that is cut small, and how many such pieces make a window.
FILLER, FILLERS_A_WINDOW = 0.1, 32

#: Not below U+0250, where letters have one spelling each, so that composing marks (NFC) changes nothing; or U+0130, whose
#: lower case is two letters, or a separator that not all call white space.
NOT_PLAIN = "[^\x00-\x1b\x20-\u012f\u0131-\u024f]"


def byte_letters() -> list[str]:
    """The letters by which byte-level vocabularies write the 256 bytes: printable bytes as themselves, others from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class Coder:
    """Ids of white-space separated words as little-endian uint32 bytes.

    The tokenizer's steps (NFC, lower case, split on white space and character classes) never look across
    ASCII white space, so a text's ids are its words' ids one after the other.  Where all letters are below
    U+0250 the steps before the merges are plain and only a word's new pieces go to the tokenizer's model;
    other words, and words that contain an added token, go through the whole tokenizer, which finds added tokens
    in a text wherever they stand.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added)), regex.IGNORECASE).search if added else lambda _: None
        self.letters = byte_letters()
        steps = json.loads(self.tokenizer.to_str())
        kinds = [x["type"] for x in (steps["normalizer"] or {}).get("normalizers", [])]
        splits = [x["pattern"]["Regex"] for x in (steps["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split" and x["invert"]]
        self.split = regex.compile(splits[0]).findall if kinds == ["NFC", "Replace", "Lowercase"] and len(splits) == 1 else None
        # the merges alone, for many pieces at once; the suffix of a piece's last token tells the pieces apart
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = WhitespaceSplit()
        suffix = steps["model"].get("end_of_word_suffix")
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for token, i in self.tokenizer.get_vocab().items() if suffix and token.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def spelled(self, piece: str) -> str:
        return piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))

    def merged(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece."""
        spelled = list(map(self.spelled, pieces))
        ids = np.array(self.merges.encode(" ".join(spelled), add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(pieces) or (len(ends) and ends[-1] != len(ids)):
            return [np.array([t.id for t in self.tokenizer.model.tokenize(x)], "<u4").tobytes() for x in spelled]
        return [ids[a:z].tobytes() for a, z in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def pieces(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Ids of each piece; those of the latest short ones are remembered."""
        known, older, found, again, new = self.known, self.older, {}, {}, []
        for x in pieces:
            if (ids := known.get(x)) is not None:
                found[x] = ids
            elif (ids := older.get(x)) is not None:
                again[x] = ids
            else:
                new.append(x)
        for a, z in slices(len(new), 5000):
            again.update(zip(new[a:z], self.merged(new[a:z]), strict=True))
        found.update(again)
        if len(known) + len(again) > REMEMBERED:
            self.older, self.known = known, {}
        self.known.update((x, ids) for x, ids in again.items() if len(x) <= LONG)
        return found

    def words(self, words: pa.Array) -> list[bytes]:
        """Ids of each word."""
        if not self.split:
            return list(map(self.whole, words.to_pylist()))
        plain = pc.invert(pc.match_substring_regex(words, NOT_PLAIN))
        low = pc.utf8_lower(words)
        alone = pc.and_(plain, pc.utf8_is_alpha(low))
        kinds = low.filter(alone).dictionary_encode()
        one = kinds.dictionary.to_pylist()
        several: list[list[str] | bytes] = []
        for word, lower, is_plain in zip(*(x.filter(pc.invert(alone)).to_pylist() for x in (words, low, plain)), strict=True):
            several.append(self.split(lower) if is_plain and not self.added(word) else self.whole(word))
        ids = self.pieces({*one, *(x for parts in several if isinstance(parts, list) for x in parts)})
        out = np.empty(len(words), object)
        at = alone.to_numpy(zero_copy_only=False)
        of_one = np.empty(len(one), object)
        of_one[:] = list(map(ids.__getitem__, one))
        out[at] = of_one[kinds.indices.to_numpy()]
        rest = np.empty(len(several), object)
        rest[:] = [b"".join(map(ids.__getitem__, x)) if isinstance(x, list) else x for x in several]
        out[~at] = rest
        return out.tolist()


_CODERS: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def encoded(texts: pa.Array, path: str, end_id: int | None = None, id_type: str = "<u4") -> pa.Array:
    """Ids of each text (null: empty) and an end id, as little-endian integers; every kind of word is looked up once."""
    texts = texts.fill_null("")
    # Arrow's white space also has four separators that the tokenizer's words may hold
    odd = pc.any(pc.match_substring_regex(texts, "[\x1c-\x1f]")).as_py()
    split = pc.split_pattern_regex(texts, "[\t-\r ]+") if odd else pc.ascii_split_whitespace(texts)
    kinds = pc.list_flatten(split).dictionary_encode()
    coded = [*coder(path).words(kinds.dictionary), b"" if end_id is None else struct.pack("<I", end_id)]
    ids = np.frombuffer(b"".join(coded), "<u4").astype(id_type)
    n = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
    first = np.cumsum(n) - n
    # the kind of every word, and of the end after each text's last
    ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    kind = np.full(ends[-1] if len(ends) else 0, len(coded) - 1, np.int32)
    inside = np.ones(len(kind), bool)
    inside[ends - 1] = False
    kind[inside] = kinds.indices.to_numpy()
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(n[kind])])
    out = np.empty(offsets[-1], id_type)
    for i in range(0, len(kind), WORDS_AT_ONCE):
        part = kind[i : i + WORDS_AT_ONCE]
        lo, hi = offsets[i], offsets[i + len(part)]
        out[lo:hi] = ids[np.repeat(first[part] - offsets[i : i + len(part)], n[part]) + np.arange(lo, hi)]
    at = np.concatenate([np.zeros(1, np.int64), offsets[ends]]) * out.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(out)]).cast(pa.binary())


def encode(text: bytes, path: str) -> bytes:
    """Ids of one text, without an end id, as little-endian uint32 bytes."""
    return encoded(pa.array([text.decode()]), path)[0].as_py()


def differencing(sizes: list[int], windows: int) -> tuple[np.ndarray, np.ndarray]:
    """The window of every size, and the windows' loads.

    A partial partition is the ascending list of its loaded windows (load, first item, items); its other windows are
    empty.  Merging lays one's heaviest windows on the other's lightest, so loaded windows meet only where the two
    have more than ``windows`` of them.
    """
    parts: dict[int, list[tuple[int, int, list[int]]]] = {i: [(s, i, [i])] for i, s in enumerate(sizes)}
    heap = [(-s, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    for node in range(len(sizes), 2 * len(sizes) - 1):
        a, b = (parts.pop(heapq.heappop(heap)[1]) for _ in range(2))
        if len(a) < len(b):
            a, b = b, a
        meet = max(0, len(a) + len(b) - windows)
        joined = [(x + y, min(i, j), p + q) for (x, i, p), (y, j, q) in zip(reversed(a[:meet]), b[:meet], strict=True)]
        if len(b) == 1:
            del a[:meet]
            for w in joined or b:
                bisect.insort(a, w)
        else:
            a = sorted(joined + a[meet:] + b[meet:])
        parts[node] = a
        heapq.heappush(heap, ((a[0][0] if len(a) == windows else 0) - a[-1][0], node))
    out, loads = np.zeros(len(sizes), np.int64), np.zeros(windows, np.int64)
    (whole,) = parts.values()
    for w, (load, _, items) in enumerate(whole):
        out[items] = w
        loads[w] = load
    return out, loads


def packed(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, window, offset) for every piece."""
    pieces, rest = [], []
    first = 0
    for i, n in enumerate(lengths):
        for start in range(0, n - n % capacity, capacity):
            pieces.append((i, start, capacity, first, 0))
            first += 1
        if n % capacity:
            rest.append((i, n - n % capacity, n % capacity))
    if not rest:
        return pieces
    rest = _with_filler(rest, capacity)
    sizes = [n for _, _, n in rest]
    # with room for what fillers leave uneven
    room = capacity // FILLERS_A_WINDOW // 8 if sum(sizes) > capacity else 0
    count, rises = -(-sum(sizes) // (capacity - room)), 0
    to, loads = differencing(sizes, count)
    while loads.max() > capacity:
        rises += 1
        count += 1 + rises // 8
        to, loads = differencing(sizes, count)
    windows: list[list[tuple[int, int, int]]] = [[] for _ in range(count)]
    for piece, w in zip(rest, to.tolist(), strict=True):
        windows[w].append(piece)
    for w in filter(None, windows):
        offset = 0
        for i, start, n in w:
            pieces.append((i, start, n, first, offset))
            offset += n
        first += 1
    return pieces


def _with_filler(rest: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int, int]]:
    """The remainders, of which the shortest, together a part of FILLER, are cut small, so that windows can become nearly equal."""
    total = sum(n for _, _, n in rest)
    if total <= capacity:
        return rest
    left, small = total * FILLER, max(1, capacity // FILLERS_A_WINDOW)
    out = []
    for i, start, n in sorted(rest, key=lambda x: x[2]):
        if left > 0:
            left -= n
            out += [(i, at, min(small, start + n - at)) for at in range(start, start + n, small)]
        else:
            out.append((i, start, n))
    return out


def _pieces(capacity: int, id_type: str):
    def over(t: pa.Table) -> pa.Table:
        ids = t["ids"].to_pylist()
        width = np.dtype(id_type).itemsize
        doc, group = t["doc_id"].to_pylist(), t["group"][0].as_py()
        rows = []
        for i, start, n, window, offset in packed([len(x) // width for x in ids], capacity):
            part = np.frombuffer(ids[i], id_type)[start : start + n].astype("<u4").tobytes()
            rows.append((doc[i], start, n, zlib.crc32(part), len(ids[i]) // width, (group << 32) | window, offset))
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.table({k: pa.array(c, pa.int64()) for k, c in zip(names, zip(*rows, strict=True), strict=True)})

    return over


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, group_tokens: int = GROUP_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer: path of a tokenizers file whose steps never look across ASCII white space.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    id_type = "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z in byte_slices(b["text"], BYTES_AT_ONCE):
                part = b.slice(a, z - a)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["group"], encoded(part["text"], path, end_id, id_type)], names=["doc_id", "group", "ids"])

    size = docs.agg(F.sum(F.octet_length(text_col)).alias("bytes")).first()["bytes"] or 0
    groups = max(1, round(size / 4 / group_tokens))  # about four bytes a token
    rows = with_row(docs, id_col, text_col).select("doc_id", "text", F.pmod(F.xxhash64("_row"), F.lit(groups)).alias("group"))
    coded = rows.mapInArrow(ids, "doc_id long, group long, ids binary")
    return coded.groupBy("group").applyInArrow(_pieces(capacity, id_type), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """Operator 9 over all documents: sequences of at most 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
