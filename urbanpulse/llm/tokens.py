"""BPE encoding and decoding with a minimal acyclic transducer lexicon (operator 1).

The most frequent words of the corpus are counted over all documents, encoded once and compiled
with their ids into a minimal transducer. Its file goes to the shared folder, Spark hands it
to every executor, and tasks memory-map it. Words that the transducer lacks are merged exactly,
so its size (`words`, at most LEXICON_WORDS by default) changes the speed and never an id.

Null and empty texts give no ids and the empty text; a special token's string inside a text
becomes that token; repeated rows are encoded each; only doc_id and text are read, so further
columns, whatever their names, do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from public_tokenizers import path as tokenizer_path
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanpulse.llm.bpe import Vocabulary, vocabulary
from urbanpulse.llm.lexicon import Lexicon, compile_lexicon
from urbanpulse.llm.spelling import Spelling, spelling
from urbanpulse.llm.text import Memory, runs, space_split, text_slices
from urbanpulse.session import checkpoint_dir, materialise

LEXICON_WORDS = 65_536
SLICE_CHARS = 1_000_000
REMEMBERED = 120_000  # distinct pieces whose ids a task holds
DECODED = 256  # documents decoded at a time
COUNTED = 200_000  # distinct pieces counted by a task before it hands them on

# The word pattern of vocabularies with word ends; a fixed value. Pieces hold no white space.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{L}\p{N}]+")


def special_pattern(vocab: Vocabulary) -> re.Pattern | None:
    names = sorted(vocab.specials, key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None


def pieces_of(text: str, special: re.Pattern | None, spelled: Spelling) -> list[str]:
    """The white-space pieces of a text, normalised; special tokens stand in it as they are."""
    if special is None or not special.search(text):
        return space_split(spelled.normalise(text))
    parts = enumerate(special.split(text))
    return [p for k, part in parts for p in ([part] if k % 2 else space_split(spelled.normalise(part)))]


def count_words(batches, path: str, spelled: Spelling):
    special = special_pattern(vocabulary(path))
    specials = vocabulary(path).specials
    counts: Counter[str] = Counter()

    def flush():
        words: Counter[str] = Counter()
        for piece, n in counts.items():
            for word in spelled.cut(piece, WORDS) if piece not in specials else ():
                words[word] += n
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], ["word", "n"])

    for _, texts in text_slices(batches, most=SLICE_CHARS):
        for text in texts:
            counts.update(pieces_of(text, special, spelled))
        if len(counts) > COUNTED:
            yield flush()
    yield flush()


def frequent_words(docs: DataFrame, path: str, words: int = LEXICON_WORDS) -> list[str]:
    """At most `words` words, the most frequent ones over all documents.

    Counts are first tallied in logarithmic bins, so that only words of the bins taken reach the driver.
    """
    spelled = spelling()
    texts = docs.select(F.col("text").cast("string").alias("text"))
    partial = texts.mapInArrow(lambda b: count_words(b, path, spelled), "word string, n long")
    counts = materialise(partial.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
                         .withColumn("bin", F.floor(F.log2("n") * 16).cast("int")))
    least, taken = None, 0
    for row in counts.groupBy("bin").count().orderBy(F.desc("bin")).collect():
        taken += row["count"]
        if taken > words:
            break
        least = row.bin
    return [] if least is None else [r.word for r in counts.where(F.col("bin") >= least).select("word").collect()]


def ship(spark: SparkSession, data: bytes) -> str:
    """Write bytes to the shared folder and let Spark hand the file to the executors; returns its name."""
    name = f"lexicon-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/{name}")
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
    spark.sparkContext.addFile(path.toString())
    return name


def build_lexicon(docs: DataFrame, path: str | None = None, words: int = LEXICON_WORDS) -> str:
    """Compile the frequent words of `docs`; returns the file's name for `encode`."""
    file = path or tokenizer_path("word_bpe_49k.json")
    frequent = frequent_words(docs, file, words)
    ids, lengths = vocabulary(file).encode_words(frequent)
    return ship(docs.sparkSession, compile_lexicon(frequent, ids, lengths))


class WordIds:
    """Ids of distinct pieces as rows of packed bytes: the transducer's, or exactly merged ones."""

    def __init__(self, vocab: Vocabulary, lexicon: Lexicon, spelled: Spelling):
        self.vocab, self.lexicon, self.spelled = vocab, lexicon, spelled
        self.words = Memory(self.encode, REMEMBERED)

    def encode(self, words: list[str]) -> np.ndarray:
        place = self.lexicon.find(words)
        packed = np.empty(len(words), object)
        missing = np.flatnonzero(place < 0)
        ids, lengths = self.vocab.encode_words([words[i] for i in missing])
        seen = np.flatnonzero(place >= 0)
        start, stop = self.lexicon.start[place[seen]], self.lexicon.start[place[seen] + 1]
        known = self.lexicon.ids[runs(start.astype(np.int64), (stop - start).astype(np.int64))]
        for rows, data, sizes in ((missing, ids, lengths), (seen, known, stop - start)):
            raw, ends = data.astype("<u4").tobytes(), (np.cumsum(sizes) * 4).tolist()
            packed[rows] = [raw[a:b] for a, b in zip([0, *ends], ends)]
        return packed

    def __call__(self, pieces: list[str]) -> np.ndarray:
        out = np.empty(len(pieces), object)
        cut = [[] if p in self.vocab.specials else self.spelled.cut(p, WORDS) for p in pieces]
        flat = self.words([w for ws in cut for w in ws]).tolist() if any(cut) else []
        at = 0
        for i, (piece, words) in enumerate(zip(pieces, cut)):
            out[i] = b"".join(flat[at:at + len(words)]) if words else self.vocab.specials[piece].to_bytes(4, "little")
            at += len(words)
        return out


def encode_batches(batches, path: str, lexicon: str, spelled: Spelling):
    vocab = vocabulary(path)
    special = special_pattern(vocab)
    memory = Memory(WordIds(vocab, Lexicon(SparkFiles.get(lexicon)), spelled), REMEMBERED)
    for part, texts in text_slices(batches, most=SLICE_CHARS):
        pieces = [pieces_of(t, special, spelled) for t in texts]
        packed = memory([p for ps in pieces for p in ps]).tolist() if any(pieces) else []
        rows, at = [], 0
        for own in pieces:
            rows.append(b"".join(packed[at:at + len(own)]))
            at += len(own)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, pa.binary())], ["doc_id", "ids"])


def encode(docs: DataFrame, lexicon: str, path: str | None = None) -> DataFrame:
    """doc_id and ids: the ids as little-endian unsigned 32-bit integers, packed."""
    file = path or tokenizer_path("word_bpe_49k.json")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    spelled = spelling()
    return rows.mapInArrow(lambda b: encode_batches(b, file, lexicon, spelled), "doc_id long, ids binary")


def decode_batches(batches, path: str):
    tokens = vocabulary(path).tokens
    names = [tokens.get(i) for i in range(max(tokens) + 1)]
    for batch in (b.slice(k, DECODED) for b in batches for k in range(0, b.num_rows, DECODED)):
        texts = [" ".join(map(names.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and decoded: the tokens joined by blanks, as a vocabulary without a decoder gives them."""
    file = path or tokenizer_path("word_bpe_49k.json")
    return encoded.select("doc_id", F.coalesce("ids", F.lit(b"")).alias("ids")).mapInArrow(
        lambda b: decode_batches(b, file), "doc_id long, ids binary, decoded string")


def round_trip(docs: DataFrame, path: str | None = None, words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, ids, decoded of every document: `decode` of `encode`, in one Python worker a task."""
    file = path or tokenizer_path("word_bpe_49k.json")
    lexicon, spelled = build_lexicon(docs, path, words), spelling()
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(lambda b: decode_batches(encode_batches(b, file, lexicon, spelled), file), "doc_id long, ids binary, decoded string")


def digests(coded: DataFrame) -> DataFrame:
    """Number and SHA-256 of the ids, SHA-256 of the decoded text."""
    return coded.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
