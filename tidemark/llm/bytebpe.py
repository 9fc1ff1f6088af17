"""Byte-level BPE encoding and decoding with the tokenizers library, over Arrow batches."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, keyed, slices

RANKS = "byte_bpe_50k.tiktoken"

#: Distinct text pieces whose ids a Python worker remembers between texts (about 60 MB); others are encoded again.
REMEMBERED = 1 << 18


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merges(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The two parts of each token that were merged last: what BPE with lower ranks alone leaves of its bytes."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            _, at = min((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


class ByteBpe:
    """Text to ids and back. Pieces cut at a single blank or line break between other characters are encoded apart:
    the pattern always starts a new match there (a blank joins what follows, a line break stands alone)."""

    def __init__(self, path: str, pattern: str, remembered: int = REMEMBERED):
        import os

        import public_tokenizers

        if pattern != public_tokenizers.PATTERN:
            raise ValueError("texts are cut by what holds for public_tokenizers.PATTERN; another pattern needs rules of its own")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks, letters = read_ranks(path), byte_characters()
        named = lambda b: "".join(letters[x] for x in b)
        model = models.BPE({named(b): r for b, r in ranks.items()}, [(named(a), named(b)) for a, b in merges(ranks)], cache_capacity=1 << 14)
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.letters = {c: b for b, c in enumerate(letters)}
        size = max(ranks.values(), default=-1) + 1
        self.id_objects, self.decimal, self.bytes = list(range(size)), [str(i) for i in range(size)], [b""] * size
        for b, r in ranks.items():
            self.bytes[r] = b
        self.known: dict[str, tuple[int, ...]] = {}
        self.remembered = remembered

    def offsets(self, text: str) -> list[tuple[int, int, int]]:
        """(id, start, end) in UTF-8 bytes of the text. The library's offsets are of characters; a token that holds
        only some bytes of a character has that character's, so byte ends come from the reversed byte table."""
        out, at = [], 0
        for i in self.encode([text])[0]:
            out.append((i, at, at + len(self.bytes[i])))
            at = out[-1][2]
        return out

    def spans(self, text: str) -> list[tuple[int, int]]:
        """The library's character offsets of each token; parts of a split character share its offsets."""
        return self.tokenizer.encode(text, add_special_tokens=False).offsets

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, special strings taken as ordinary text."""
        cut = [self.cut(t) for t in texts]
        known, own = self.known, self.id_objects
        fresh: dict[str, tuple[int, ...]] = {p: () for p in chain.from_iterable(cut) if p not in known}
        names = list(fresh)
        for a in range(0, len(names), 4096):
            part = names[a : a + 4096]
            for p, e in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False), strict=True):
                fresh[p] = tuple([own[i] for i in e.ids])
        room = self.remembered - len(known)
        if room > 0:
            known.update(islice(((p, x) for p, x in fresh.items() if len(p) <= 64), room))
        get = known.get
        return [[i for p in c for i in get(p) or fresh[p]] for c in cut]

    @staticmethod
    def cut(text: str) -> list[str]:
        """Pieces that can be encoded apart; joined they are the text."""
        if not text:
            return []
        lines = text.split("\n")
        if any(not x or x[0].isspace() or x[-1].isspace() for x in lines):
            return [text]
        out: list[str] = []
        for k, line in enumerate(lines):
            if k:
                out.append("\n")
            first, *rest = line.split(" ")
            if not all(p and not p[0].isspace() and not p[-1].isspace() for p in rest) or first[-1].isspace():
                return [text]
            out.append(first)
            out += [" " + p for p in rest]
        return out

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """Text of any run of ids; bytes of a character that the run splits become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


_loaded: dict[tuple, ByteBpe] = {}


def loaded(path: str, pattern: str) -> ByteBpe:
    """One tokenizer for each Python worker and file."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBpe(path, pattern)
    return _loaded[path, pattern]


def vocabulary(name: str) -> Callable[[], str]:
    """Where executors find a vocabulary file; looked up there, so that only its name travels."""

    def place() -> str:
        import public_tokenizers

        return public_tokenizers.path(name)

    return place


def round_trip(place: Callable[[], str], pattern: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (key, text): counts, digests of the ids and of the bytes that decoding returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        bpe = loaded(place(), pattern or public_tokenizers.PATTERN)
        for batch in batches:
            keys, texts = batch.column(0), [x or "" for x in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                n, of_ids, of_bytes = [], [], []
                for ids in bpe.encode(texts[a:b]):
                    n.append(len(ids))
                    of_ids.append(hashlib.sha256(" ".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest())
                    of_bytes.append(hashlib.sha256(bpe.decode_bytes(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(a, b - a), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return run


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", place: Callable[[], str] | None = None, pattern: str | None = None) -> DataFrame:
    """key and ids (array<int>) of each text; null and empty texts have no ids."""
    place = place or vocabulary(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        bpe = loaded(place(), pattern or public_tokenizers.PATTERN)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(bpe.encode(texts[a:b]), pa.list_(pa.int32()))], ["key", "ids"])

    schema = keyed(docs.schema[key].dataType, "ids array<int>")
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", place: Callable[[], str] | None = None) -> DataFrame:
    """key and text of each row of ids. Null ids: null. Bytes that are not whole characters become U+FFFD."""
    place = place or vocabulary(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        bpe = loaded(place(), public_tokenizers.PATTERN)
        for batch in batches:
            out = [None if x is None else bpe.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["key", "text"])

    schema = keyed(encoded.schema[key].dataType, "text string")
    return encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, schema).withColumnRenamed("key", key)


def digests(docs: DataFrame, place: Callable[[], str] | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text (null: empty), a row each, repeats and null ids included.

    Texts of any length are cut into pieces of bounded size. Other columns, whatever their names, are left out; an empty table gives no rows.
    """
    run = round_trip(place or vocabulary(RANKS))
    schema = keyed(docs.schema["doc_id"].dataType, "n_tokens long, ids_sha256 string, decoded_sha256 string", "doc_id")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """digests() of all documents: a row each, repeats and null ids included; null and empty texts have no tokens; no documents, no rows."""
    return digests(documents(spark, sf_dir))
