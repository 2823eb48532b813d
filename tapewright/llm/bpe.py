"""BPE encoding and decoding through a table of distinct words.

Texts are split at white space, in blocks of bounded size. Each block sends its distinct words to shards of the
word table by their hash; a shard is a stream of such rows, whatever the number of blocks, and encodes every distinct
word once: it holds its distinct words and nothing else. The ids come back to the block and are joined to the positions
of the words; an id is joined to its piece in the vocabulary, whose size the tokenizer file bounds.

Splitting first is exact for tokenizers whose normalizer and pre-tokenizer never reach across white space; others are
refused.
"""

from __future__ import annotations

import functools
import json
import math
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm import chunks
from tapewright.llm.columns import id_and_text

# Text of a shard of the word table, and the power of the text with which shards grow: words grow slower than text.
SHARD_BYTES, SHARD_GROWTH = 16_000_000, 0.75
# Words that a shard looks up at once, in bytes.
PART_BYTES = 4_000_000
# Words whose shard a block works out at once.
WORDS_AT_ONCE = 32_768
# Two workers of an executor hold a block each beside the JVM: text in a block, rows in a batch from Spark.
BLOCK_BYTES = 4_000_000
ARROW_ROWS = 1000

_WORDS = "shard int, block long, first long, words binary"
_IDS = "block long, first long, sizes binary, ids binary"
_TEXTS = "block long, doc_ids binary, has_id binary, ends binary, codes binary"
_RESULT = "doc_id long, ids array<int>, decoded string"


# What a tokenizer file must say for words to be encoded on their own. Text is composed, lower-cased and
# cut into runs of letters, single digits and runs of signs, without white space; bytes are spelled as characters.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}


def _words_stand_alone(told: dict) -> bool:
    normalizers = (told.get("normalizer") or {}).get("normalizers", [])
    parts = (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if [n["type"] for n in normalizers] != _NORMALIZERS or len(parts) != 2:
        return False
    blank = normalizers[1]["pattern"] == {"Regex": r"\s+"} and normalizers[1]["content"] == " "
    cut = parts[0].get("pattern") == {"Regex": _SPLIT} and parts[0].get("behavior") == "Removed" and parts[0].get("invert") is True
    spelled = all(parts[1].get(k) == v for k, v in _BYTES.items())
    whole = all(a["normalized"] is False and not a["lstrip"] and not a["rstrip"] and " " not in a["content"] for a in told.get("added_tokens", []))
    return blank and cut and spelled and whole and told.get("decoder") is None and told["model"]["type"] == "BPE" and not told["model"].get("dropout")


@functools.cache
def tokenizer(path: str):
    """The tokenizer of a file; a ValueError unless its words can be encoded one by one."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    with open(path, encoding="utf-8") as file:
        if not _words_stand_alone(json.load(file)):
            raise ValueError(f"{path}: only tokenizers that lower-case, drop white space and split as the word tokenizers do are supported")
    return loaded


@functools.cache
def _pieces(path: str) -> pa.Array:
    """The piece of every id, at the place of the id."""
    known = tokenizer(path)
    size = max(known.get_vocab(with_added_tokens=True).values(), default=-1) + 1
    return pa.array([known.id_to_token(i) or "" for i in range(size)], pa.large_string())


# A word of Latin letters and the punctuation after it. The pre-tokenizer parts them, too, and these letters are
# lower-cased one by one and need no composition, so both can be encoded on their own.
_LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+"
_TAIL = ".,;:!?"


# Lower-case Latin words: normalizer and pre-tokenizer leave them as they are, but for the spelling of their bytes.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")


@functools.cache
def _byte_spelling() -> dict[int, str]:
    """Characters beyond ASCII as the byte-level alphabet spells them.

    Fixed values: bytes of printable Latin-1 characters stand for themselves, the others count up from 256.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    spelled = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}
    return {c: "".join(spelled[b] for b in chr(c).encode()) for c in range(128, 256)}


def _encode_distinct(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Number of ids of each word and all ids in a row, word by word through the library."""
    known = tokenizer(path)
    sizes, ids = [np.empty(0, np.int32)], [np.empty(0, np.int32)]
    for start in range(0, len(words), 10_000):
        part = words[start : start + 10_000]
        plain = [_PLAIN.fullmatch(w) is not None for w in part]
        rest = iter(known.encode_batch_fast([w for w, p in zip(part, plain) if not p], add_special_tokens=False))
        model, spelling = known.model, _byte_spelling()
        found = [[t.id for t in model.tokenize(w if w.isascii() else w.translate(spelling))] if p else next(rest).ids for w, p in zip(part, plain)]
        sizes.append(np.array([len(f) for f in found], dtype=np.int32))
        ids.append(np.array([i for f in found for i in f], dtype=np.int32))
    return np.concatenate(sizes), np.concatenate(ids)


def encode_words(words: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Number of ids of each word and all ids in a row; words that differ in case or punctuation share the work."""
    words = words.cast(pa.large_string())
    core = pc.utf8_rtrim(words, characters=_TAIL)
    split = pc.match_substring_regex(core, f"{_LETTERS}$")
    none = pa.scalar("", pa.large_string())
    tail = pc.if_else(split, pc.replace_substring_regex(words, _LETTERS, ""), none)
    parts = pa.concat_arrays([pc.if_else(split, pc.utf8_lower(core), words), tail])
    coded = pc.dictionary_encode(parts)
    sizes, ids = _encode_distinct(coded.dictionary.to_pylist(), path)
    starts = np.cumsum(sizes, dtype=np.int64) - sizes
    pairs = coded.indices.to_numpy(zero_copy_only=False).reshape(2, -1).T
    both = sizes[pairs]
    return both.sum(axis=1, dtype=np.int32), ids[gather(starts[pairs].reshape(-1), both.reshape(-1))]


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of consecutive runs: ``sizes[i]`` places from ``starts[i]`` on, for each i in turn."""
    ends = np.cumsum(sizes, dtype=np.int64)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int64)


def _pack(values: np.ndarray) -> bytes:
    """Bytes of the same weight together, compressed."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes(), 1)


def _unpack(data: bytes, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(dtype)


def _split(batches: Iterator[pa.RecordBatch], shards: int):
    """Blocks as (number, rows, words in shard order, first place of each shard, word number at each place, ends)."""
    task = TaskContext.get()
    for nth, rows in enumerate(chunks.blocks(batches, size=BLOCK_BYTES)):
        words, codes, ends = chunks.factorize(rows.column("text"))
        shard = np.empty(len(words), dtype=np.int64)
        for start in range(0, len(words), WORDS_AT_ONCE):
            some = words.slice(start, WORDS_AT_ONCE).to_pylist()
            shard[start : start + len(some)] = [xxhash.xxh64_intdigest(w) % shards for w in some]
        order = np.argsort(shard, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        bounds = np.searchsorted(shard[order], np.arange(shards + 1))
        codes = place[codes].astype(np.uint32)
        # Both passes must cut the same blocks; the number holds what they saw, so a difference cannot go unnoticed.
        seen = xxhash.xxh64(f"{task.partitionId() if task else 0}/{nth}")
        seen.update(codes.tobytes())
        seen.update(ends.tobytes())
        yield np.uint64(seen.intdigest()).astype(np.int64), rows, words.take(pa.array(order)), bounds, codes, ends


def _words_of_blocks(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for block, _, words, bounds, _, _ in _split(batches, shards):
        some = np.flatnonzero(np.diff(bounds))
        # A word holds no space, and many words of a block compress well together.
        packed = [zstandard.compress(" ".join(words.slice(bounds[k], bounds[k + 1] - bounds[k]).to_pylist()).encode(), 1) for k in some]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(np.full(len(some), block)), pa.array(bounds[some]), pa.array(packed, pa.binary())],
            ["shard", "block", "first", "words"],
        )


def _texts_of_blocks(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for block, rows, _, _, codes, ends in _split(batches, shards):
        ids = rows.column("doc_id").combine_chunks()
        known = pc.is_valid(ids).to_numpy(zero_copy_only=False)
        packed = [_pack(ids.fill_null(0).to_numpy()), _pack(known.astype(np.uint8)), _pack(ends.astype(np.int64)), _pack(codes)]
        columns = [pa.array([block])] + [pa.array([p], pa.binary()) for p in packed]
        yield pa.RecordBatch.from_arrays(columns, ["block", "doc_ids", "has_id", "ends", "codes"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Some rows of a shard at a time with their words, about ``PART_BYTES`` of them."""
    for batch in batches:
        first, filled, texts = 0, 0, []
        for k, packed in enumerate(batch.column("words")):
            texts.append(zstandard.decompress(packed.as_py()).decode())
            filled += len(texts[-1])
            if filled >= PART_BYTES or k + 1 == batch.num_rows:
                yield batch.slice(first, k + 1 - first), texts
                first, filled, texts = k + 1, 0, []


def _encode_shard(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Ids of the words of one shard, a row for each block that sent some; every distinct word is encoded once."""
    known, sizes, ids = pa.array([], pa.large_string()), np.empty(0, np.int32), np.empty(0, np.int32)
    for rows, texts in _parts(batches):
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        # Words that were met before keep their numbers, new ones follow.
        coded = pc.dictionary_encode(pa.concat_arrays([known, lists.flatten()]))
        at = coded.indices.to_numpy(zero_copy_only=False)[len(known) :]
        more_sizes, more_ids = encode_words(coded.dictionary.slice(len(known)), path)
        known, sizes, ids = coded.dictionary, np.concatenate([sizes, more_sizes]), np.concatenate([ids, more_ids])
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        of_sizes, of_ids = [], []
        for begin, end in zip(np.concatenate(([0], ends[:-1])), ends):
            part = at[begin:end]
            of_sizes.append(_pack(sizes[part]))
            of_ids.append(_pack(ids[gather(starts[part], sizes[part])]))
        columns = [rows.column("block"), rows.column("first"), pa.array(of_sizes, pa.binary()), pa.array(of_ids, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["block", "first", "sizes", "ids"])
    del known, sizes, ids
    chunks.release()


def _join_runs(values: pa.Array, at: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Strings (large) at the places of each run, joined by one space."""
    offsets = np.concatenate(([0], ends)).astype(np.int64)
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), values.take(pa.array(at))), pa.scalar(" ", pa.large_string()))


def _assemble_block(words: pa.Table, held: pa.Table, path: str) -> pa.Table:
    """Ids and decoded text of the documents of one block."""
    texts, parts = held.to_pylist(), words.sort_by("first").to_pylist()
    if len(texts) != 1:
        raise RuntimeError("the two passes over the texts cut different blocks; write the documents to a table first")
    doc_ids, known = _unpack(texts[0]["doc_ids"], "int64"), _unpack(texts[0]["has_id"], "uint8") == 1
    ends, codes = _unpack(texts[0]["ends"], "int64"), _unpack(texts[0]["codes"], "uint32")
    sizes = np.concatenate([_unpack(p["sizes"], "int32") for p in parts] or [np.empty(0, np.int32)])
    ids = np.concatenate([_unpack(p["ids"], "int32") for p in parts] or [np.empty(0, np.int32)])
    if (int(codes.max()) + 1 if len(codes) else 0) != len(sizes):
        raise RuntimeError("words of a block are missing; write the documents to a table first")
    word_ends = np.cumsum(sizes, dtype=np.int64)
    # A word that is white space to the tokenizer alone has no ids and leaves no gap in the joined text.
    full = sizes[codes] > 0
    codes, ends = codes[full], np.concatenate(([0], np.cumsum(full, dtype=np.int64)))[ends]
    decoded_words = _join_runs(_pieces(path), ids, word_ends)
    out = []
    step = 512
    for first in range(0, len(doc_ids), step):
        own = ends[first : first + step]
        begin = ends[first - 1] if first else 0
        at = codes[begin : own[-1]]
        n = sizes[at]
        flat = ids[gather(word_ends[at] - n, n)]
        id_ends = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))[np.concatenate(([begin], own)) - begin]
        out.append(
            pa.record_batch(
                [
                    pa.array(doc_ids[first : first + step], mask=~known[first : first + step]),
                    pa.ListArray.from_arrays(pa.array(id_ends.astype(np.int32)), pa.array(flat)),
                    _join_runs(decoded_words, at, own - begin).cast(pa.string()),
                ],
                names=["doc_id", "ids", "decoded"],
            )
        )
    result = pa.Table.from_batches(out)
    chunks.release()
    return result


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (without special tokens added) and the text decoded from them.

    A null or empty text has no ids and decodes to an empty text. Special tokens spelled out in a text are single
    ids, as the library has it, and are kept by decoding. Repeated rows and null ids each get their row; an empty
    table gives none; further columns play no part. ``docs`` is read twice and must be a table or files, so that
    both passes see the same batches; if they do not, the job fails rather than mix up texts. Run it within
    ``session.arrow_rows`` of ``ARROW_ROWS``, so that long texts come in small batches.
    """
    tokenizer(tokenizer_path)  # a file that is not supported fails here
    texts = id_and_text(docs, id_col, text_col)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(16, math.ceil((size / SHARD_BYTES) ** SHARD_GROWTH))
    # A partition is a shard of the word table.
    encoded = (
        texts.mapInArrow(lambda batches: _words_of_blocks(batches, shards), _WORDS)
        .repartitionById(shards, F.col("shard")).mapInArrow(lambda batches: _encode_shard(batches, tokenizer_path), _IDS)
    )
    held = texts.mapInArrow(lambda batches: _texts_of_blocks(batches, shards), _TEXTS)
    return (
        encoded.groupBy("block").cogroup(held.groupBy("block"))
        .applyInArrow(lambda words, rows: _assemble_block(words, rows, tokenizer_path), _RESULT)
    )
