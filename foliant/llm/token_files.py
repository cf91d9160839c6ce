"""Token ids as Parquet list columns, written in order and read selectively.

Each file holds documents in ascending key order with the columns

* the key,
* ``part``: number of the key range that the file belongs to,
* ``offset``: tokens of the part's earlier documents,
* ``n_tokens`` and ``tokens``, the ids as a list of integers.

Row groups and pages have the sizes asked for, and every page its entry in the
column and offset indexes, so a reader that names a key range or leaves
``tokens`` out reads only those pages.  Ids are dictionary coded (a vocabulary
fits one dictionary) or delta coded; the other columns are delta coded.
"""

from __future__ import annotations

import os
import string
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.shared import once_per_worker

#: Words whose ids a worker keeps, and the characters up to which it keeps them.
KEPT_WORDS, KEPT_LENGTH = 600_000, 48
#: Words in one call of the tokenizer, and characters of text taken at a time.
WORDS_PER_CALL, CHARACTERS_AT_ONCE = 1000, 2 << 20
#: Signs: where no letter follows, a run of them is a stretch of its own after letters.
SIGNS = string.punctuation


@dataclass(frozen=True)
class FileLayout:
    """Encoding of the ids, and sizes of row groups and pages in bytes and rows."""

    encoding: str = "dictionary"  # or "delta"
    row_group_bytes: int = 32 << 20
    page_bytes: int = 256 << 10
    page_rows: int = 1000

    def options(self, key: str) -> dict[str, str]:
        if self.encoding not in ("dictionary", "delta"):
            raise ValueError(f"no encoding {self.encoding!r}")
        coded = str(self.encoding == "dictionary").lower()
        plain = (key, "part", "offset", "n_tokens")
        return {
            "parquet.writer.version": "v2",
            "parquet.block.size": str(self.row_group_bytes),
            "parquet.page.size": str(self.page_bytes),
            "parquet.page.row.count.limit": str(self.page_rows),
            "parquet.dictionary.page.size": str(1 << 20),
            "parquet.enable.dictionary#tokens.list.element": coded,
            **{f"parquet.enable.dictionary#{name}": "false" for name in plain},
        }


def _stays_letters(word: str) -> bool:
    """Whether a word is of letters alone, also after normalisation, so that signs stand apart.

    Some capitals become a letter with a mark of its own, which would join the signs.
    """
    return word.isalpha() and (word.isascii() or unicodedata.normalize(
        "NFC", unicodedata.normalize("NFC", word).lower()).isalpha())


class Kept(dict):
    """Ids by word: the newer half of what is kept; when it is full, the older one goes."""

    def __init__(self, size: int):
        super().__init__()
        self.half, self.older = size // 2, {}

    def __missing__(self, word: str) -> bytes | None:
        ids = self.older.get(word)
        if ids is not None:
            self[word] = ids
        return ids

    def add(self, words: list[str], ids: list[bytes]) -> None:
        self.update(pair for pair in zip(words, ids) if len(pair[0]) <= KEPT_LENGTH)

    def age(self) -> None:
        if len(self) > self.half:
            self.older = dict(self)
            self.clear()


class WordIds:
    """Packed ids of texts from the ids of their words.

    For tokenizers that drop white space, lower-case, and split letters from
    signs before they merge: a text's ids are then those of its words in turn,
    and a word's ids those of its letters and of the signs after them.  Some
    texts are taken at a time; each of their different words is looked up
    once, and given to the tokenizer where its ids are not kept.
    """

    def __init__(self, content: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        suffix = self.tokenizer.model.end_of_word_suffix
        self.ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        #: Words of letters, and all others, which include runs of signs.
        self.cores, self.others = Kept(KEPT_WORDS * 5 // 6), Kept(KEPT_WORDS // 6)

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as it is; offsets, which nobody asks for, are not worked out."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(one.ids, dtype="<u4").tobytes() for one in found]

    def letters(self, cores: list[str]) -> list[bytes]:
        """Ids of words of letters, told apart in one call by the ends of words."""
        packed = self.whole([" ".join(cores)])[0]
        stops = 4 * (np.flatnonzero(self.ends[np.frombuffer(packed, dtype="<u4")]) + 1)
        if len(stops) != len(cores):
            return self.whole(cores)
        stops = stops.tolist()
        return [packed[a:b] for a, b in zip([0, *stops], stops)]

    @staticmethod
    def learn(words: list[str], ids_of: Callable, kept: Kept) -> dict[str, bytes]:
        """Ids of new words, some in a call; they are kept."""
        found = {}
        for i in range(0, len(words), WORDS_PER_CALL):
            some = words[i : i + WORDS_PER_CALL]
            ids = ids_of(some)
            found.update(zip(some, ids))
            kept.add(some, ids)
        return found

    def of_words(self, words: list[str], cores: list[str]) -> list[bytes]:
        """Ids of different words, given each without the signs at its end."""
        self.cores.age()
        self.others.age()
        found = list(map(self.cores.__getitem__, cores))
        missing = [i for i, ids in enumerate(found) if ids is None]
        new = {core for core in map(cores.__getitem__, missing) if _stays_letters(core)}
        learned = self.learn(list(new), self.letters, self.cores)
        rest = []
        for i in missing:
            found[i] = ids = learned.get(cores[i])
            if ids is None:
                rest.append(i)
        alone = set(rest)
        signed = [
            i for i, (word, core) in enumerate(zip(words, cores))
            if len(word) != len(core) and i not in alone
        ]
        others = [words[i] for i in rest] + [words[i][len(cores[i]):] for i in signed]
        known = list(map(self.others.__getitem__, others))
        new = {word for word, ids in zip(others, known) if ids is None}
        learned = self.learn(list(new), self.whole, self.others)
        for at, i in enumerate(rest + signed):
            ids = known[at]
            if ids is None:
                ids = learned[others[at]]
            found[i] = ids if at < len(rest) else found[i] + ids
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of texts."""
        split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, type=pa.string())))
        coded = split.flatten().dictionary_encode()
        words, cores = (
            some.to_numpy(zero_copy_only=False).tolist()
            for some in (coded.dictionary, pc.ascii_rtrim(coded.dictionary, SIGNS))
        )
        ids_of = self.of_words(words, cores)
        ids = map(ids_of.__getitem__, coded.indices.to_numpy().tolist())
        counts = np.asarray(split.value_lengths()).tolist()
        return [b"".join(islice(ids, count)) for count in counts]


def _stretches(text: str) -> Iterator[str]:
    """A long text cut at blanks."""
    at = 0
    while len(text) - at > CHARACTERS_AT_ONCE:
        cut = text.rfind(" ", at, at + CHARACTERS_AT_ONCE)
        cut = text.find(" ", at + CHARACTERS_AT_ONCE) if cut < 0 else cut
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def _groups(texts: list[str]) -> Iterator[list[str]]:
    """Texts in runs of about as many characters."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= CHARACTERS_AT_ONCE:
            yield group
            group, size = [], 0
    if group:
        yield group


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int, key: str = "doc_id",
    text: str = "text", layout: FileLayout = FileLayout(),
) -> None:
    """Encode every whole text and write the ids in ascending order of the key.

    Ranges of the key make the parts; each is sorted and encoded by one task,
    which counts tokens as it goes.  Only the key and the text are read and
    shuffled.  Null and empty texts have just the end id; rows with a null key
    come first; rows that share a key follow each other by text.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        content = file.read()
    sent = docs.sparkSession.sparkContext.broadcast(content)
    name = ("word-ids", hash(content))
    last = np.array([end_id], dtype="<u4").tobytes()
    kind = docs.schema[key].dataType.simpleString()
    ordered = (
        docs.select(F.col(key), F.coalesce(text, F.lit("")).alias("text"))
        .repartitionByRange(F.col(key)).sortWithinPartitions(key, "text")
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = once_per_worker(name, lambda: WordIds(sent.value))
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            keys, texts, at = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False).tolist(), 0
            for group in _groups(texts):
                packed = [
                    b"".join(b"".join(coder.encode([s])) for s in _stretches(t)) + last for t in group
                ] if len(group) == 1 else [ids + last for ids in coder.encode(group)]
                counts = np.array([len(ids) // 4 for ids in packed], dtype=np.int64)
                stops = np.cumsum(counts)
                ids = np.frombuffer(b"".join(packed), dtype="<i4")
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], stops]), type=pa.int32()),
                    pa.array(ids, type=pa.int32()),
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.slice(at, len(group)),
                        pa.array(np.full(len(group), part), type=pa.int32()),
                        pa.array(before + stops - counts, type=pa.int64()),
                        pa.array(counts, type=pa.int32()), lists,
                    ],
                    names=[key, "part", "offset", "n_tokens", "tokens"],
                )
                at += len(group)
                before += int(stops[-1])

    ordered.mapInArrow(
        encode, f"`{key}` {kind}, part int, offset bigint, n_tokens int, tokens array<int>"
    ).write.options(**layout.options(key)).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows; filters on the key and columns left out are not read."""
    return spark.read.parquet(path)


def with_start(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with ``start``, the tokens of all documents before each.

    Counts per part come from the metadata columns alone.  There is one row
    per part, and as many parts as the write had shuffle partitions.
    """
    rows = read_tokens(spark, path)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("_size")).select(
        "part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before")
    )
    return rows.join(F.broadcast(parts), "part").withColumn(
        "start", F.col("_before") + F.col("offset")
    ).drop("_before")


def ids_crc32() -> Callable:
    """Column function: CRC-32 of ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("bigint")
    def crc(lists: pa.Array) -> pa.Array:
        ids = np.asarray(lists.flatten()).astype("<u4").tobytes()
        stops = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))]) * 4
        view = memoryview(ids)
        return pa.array(
            [zlib.crc32(view[a:b]) for a, b in zip(stops[:-1].tolist(), stops[1:].tolist())],
            type=pa.int64(),
        )

    return crc
