"""Token counts: huge documents are encoded in overlapping chunks that are spliced at stable boundaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytebpe import ByteBpe, vocabulary
from .common import documents, keyed, slices

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024

#: Texts over HUGE characters are cut into chunks of CHUNK, each begun OVERLAP before the end of the last.
HUGE, CHUNK, OVERLAP = 32_768, 16_384, 512

#: Distinct pieces whose counts a Python worker remembers.
REMEMBERED = 1 << 18


class Counter:
    """Counts tokens as tokenizers does for a file of kind byte-level BPE (special strings in texts are special)."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.longest = max(map(len, self.special), default=0)
        self.known: dict[str, int] = {}
        self.remembered = remembered

    def boundaries(self, text: str) -> tuple[list[int], list[int]]:
        """Starts (characters) of the pre-tokens of a chunk, and how many tokens stand before each; the end last."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        starts, before, last = [], [], object()
        for k, (word, (start, _)) in enumerate(zip(e.word_ids, e.offsets, strict=True)):
            if word is None or word != last:  # a special string has no word
                # offsets leave out the blank that a pre-token begins with
                if start and text[start - 1] == " " and word is not None and (not starts or start - 1 > starts[-1]) and e.tokens[k][0] == "Ġ":
                    start -= 1
                starts.append(start)
                before.append(k)
            last = word
        return [*starts, len(text)], [*before, len(e)]

    def count_huge(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """Tokens of a long text, from chunks.

        Up to a place p, a chunk's tokens are the whole text's if the chunk began at such a place; only its last
        characters may differ, as a match or special string could go on. A pre-token that starts at p in both chunks makes
        p a boundary of the whole text, because the pattern looks only ahead. If the overlap has no such p, it is doubled,
        to the left up to the last splice and to the right by a longer chunk.
        """
        total, at = 0, 0  # tokens before the boundary `at`
        end = min(len(text), chunk)
        starts, before = self.boundaries(text[:end])
        while end < len(text):
            wide, spliced = overlap, False
            while not spliced:
                begin = max(at, end - wide)
                stop = min(len(text), end + max(chunk, wide))
                nxt, nxt_before = self.boundaries(text[begin:stop])
                if begin == at:  # from a boundary on: nothing to splice
                    starts, before, end, spliced = nxt, nxt_before, stop, True
                    continue
                safe = end - max(self.longest, 2)
                theirs = {s + begin: n for s, n in zip(nxt, nxt_before, strict=True)}
                # chunk starts are no proof by themselves: a cut piece begins there in any case
                for s, n in zip(reversed(starts), reversed(before), strict=True):
                    p = s + at
                    if begin + self.longest < p <= safe and p in theirs and self.stable(text, p):
                        total += n
                        skip = theirs[p]
                        keep = [(s2 + begin - p, n2 - skip) for s2, n2 in zip(nxt, nxt_before, strict=True) if s2 + begin >= p]
                        starts, before = [k[0] for k in keep], [k[1] for k in keep]
                        at, end, spliced = p, stop, True
                        break
                wide *= 2
        return total + before[-1]

    @staticmethod
    def stable(text: str, p: int) -> bool:
        """Whether the start p of a pre-token in both chunks is proven: no run of blanks reaches over it."""
        return not text[p - 1].isspace()

    def count(self, texts: list[str]) -> list[int]:
        out, plain, cuts = [0] * len(texts), [], []
        for k, t in enumerate(texts):
            if len(t) > HUGE:
                out[k] = self.count_huge(t)
            elif any(s in t for s in self.special):
                out[k] = len(self.tokenizer.encode(t, add_special_tokens=False))
            else:
                plain.append(k)
                cuts.append(ByteBpe.cut(t))
        known = self.known
        fresh = {p: 0 for c in cuts for p in c if p not in known}
        names = list(fresh)
        for a in range(0, len(names), 4096):
            part = names[a : a + 4096]
            for p, e in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False), strict=True):
                fresh[p] = len(e)
        room = self.remembered - len(known)
        if room > 0:
            known.update([(p, n) for p, n in fresh.items() if len(p) <= 64][:room])
        get = known.get
        for k, c in zip(plain, cuts, strict=True):
            out[k] = sum([get(p) or fresh[p] for p in c])
        return out


_loaded: dict[str, Counter] = {}


def loaded(path: str) -> Counter:
    if path not in _loaded:
        _loaded[path] = Counter(path)
    return _loaded[path]


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, place: Callable[[], str] | None = None) -> DataFrame:
    """key, n_bytes, n_tokens and over_limit of every text. A null text counts as empty: 0 bytes, 0 tokens."""
    place = place or vocabulary(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(place())
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counter.count(texts[a:b]), pa.int64())], ["key", "n_tokens"])

    # the bytes are counted beside, by a second column of the same rows
    pair = keyed(docs.schema[key].dataType, "n_bytes long")
    rows = docs.select(F.struct(F.col(key).alias("key"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes")).alias("key"), F.col(text).alias("text"))
    out = rows.mapInArrow(run, keyed(pair, "n_tokens long"))
    return out.select(F.col("key.key").alias(key), "key.n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token_counts() of all documents: a row each, repeats and null ids included; null and empty texts have 0 bytes. Other columns are not read."""
    return token_counts(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_tokens", "over_limit")
