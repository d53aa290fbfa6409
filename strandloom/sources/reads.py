"""FASTQ and FASTA files as reads, and reads as FASTQ.

Files are read as lines, so large plain files are split among tasks (compressed ones are a task each). Lines are numbered within their
file by the sizes of the pieces before. FASTQ records are put together from four lines by their number; FASTA files are
read line after line, a file at a time, with bounded memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import MIN_LENGTH
from ..operators.lineage import by_arrow, cut
from ..operators.routing import sums_before

#: Longest header, longest fragment and overlap of forced splits of a FASTA run.
HEADER, LONGEST, OVERLAP = 250, 1050, 50
FORMATS = {"fq": "fastq", "fastq": "fastq", "fa": "fasta", "fasta": "fasta"}
RUN = re.compile("[ACGT]+")
SCHEMA = "file string, place long, sequence string, start_pos long, seq string"


def format_of(path: str) -> str:
    """By extension, .gz aside."""
    parts = path.rsplit("/", 1)[-1].lower().removesuffix(".gz").rsplit(".", 1)
    if len(parts) < 2 or parts[1] not in FORMATS:
        raise ValueError(f"unknown sequence format: {path}")
    return FORMATS[parts[1]]


def source_of(path: Column) -> Column:
    """The file's name up to its first dot."""
    return F.regexp_extract(path, r"([^/.]*)[^/]*$", 1)


def numbered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, line, value): every line of the files (ending in LF, CR or CRLF), numbered from 0 in each file."""
    raw = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("piece"), "value")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        at, n = None, 0
        for batch in it:
            file, piece = (batch.column(c).to_pylist() for c in ("file", "piece"))
            nth = np.empty(len(file), np.int64)
            for i, key in enumerate(zip(file, piece, strict=True)):
                at, n = key, n + 1 if key == at else 0
                nth[i] = n
            yield {"file": batch.column("file"), "piece": batch.column("piece"), "nth": nth, "value": batch.column("value")}

    lines = by_arrow(raw, run, "file string, piece long, nth long, value string")
    sizes = lines.groupBy("file", "piece").agg(F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # a row for each piece of a file
    offsets = sizes.select("file", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return lines.join(offsets, ["file", "piece"]).select("file", (F.col("nth") + F.col("offset")).alias("line"), "value")


def fastq_records(lines: DataFrame, strict: bool = False) -> DataFrame:
    """(file, place, sequence, comment, seq, qual): the records of each file before its first faulty one: one whose lines
    don't start with @ and +, whose sequence is empty, or whose qualities are not as many as its bases. strict: an error instead."""
    part = lambda i: F.max(F.when(F.col("line") % 4 == i, F.col("value")))
    records = lines.groupBy("file", F.floor(F.col("line") / 4).alias("place")).agg(part(0).alias("name"), part(1).alias("seq"), part(2).alias("comment"), part(3).alias("qual"))
    sound = F.col("name").startswith("@") & F.col("comment").startswith("+") & (F.col("seq") != "") & (F.length("seq") == F.length("qual"))
    blank = F.concat_ws("", "name", "seq", "comment", "qual") == ""
    records = cut(records.withColumn("sound", F.coalesce(sound, F.lit(False))).withColumn("blank", blank), "records")
    faulty = records.where("not sound").groupBy("file").agg(F.min("place").alias("first_faulty"))
    if strict:
        wrong = records.where("not sound and not blank").select("file", "place").first()
        if wrong:
            raise ValueError(f"faulty record {wrong.place} in {wrong.file}")
    kept = records.where("sound").join(faulty, "file", "left").where("first_faulty is null or place < first_faulty")
    return kept.select("file", "place", F.substring("name", 2, 1 << 30).alias("sequence"), F.substring("comment", 2, 1 << 30).alias("comment"), "seq", "qual")


class FastaState:
    """One file's state: `line` and `end` give out fragments (sequence, start, bases): runs of uppercase ACGT, which go on over
    line ends; long ones are split with an overlap."""

    def __init__(self, file: str, min_length: int):
        self.file, self.min_length = file, min_length
        self.header: str | None = None
        self.place, self.start, self.held, self.split = 0, 0, "", False

    def _run_ends(self) -> Iterator[tuple[str, int, str]]:
        if len(self.held) >= self.min_length:
            yield self.header, self.start, self.held
        self.held, self.split = "", False

    def line(self, text: str) -> Iterator[tuple[str, int, str]]:
        if text.startswith(">"):
            yield from self._run_ends()
            self.header, self.place = text[1 : HEADER + 1].split(" ", 1)[0], 0
            return
        if self.header is None:
            if text.strip():
                raise ValueError(f"{self.file} does not start with a > line")
            return
        for run in RUN.finditer(text):
            if self.held and (run.start() > 0 or self.place != self.start + len(self.held)):
                yield from self._run_ends()
            if not self.held:
                self.start = self.place + run.start()
            self.held += run.group()
            while len(self.held) >= LONGEST:
                yield self.header, self.start, self.held[:LONGEST]
                self.start, self.held = self.start + LONGEST - OVERLAP, self.held[LONGEST - OVERLAP :]
        self.place += len(text)

    def end(self) -> Iterator[tuple[str, int, str]]:
        if self.header is not None:
            yield from self._run_ends()


def fasta_fragments(lines: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(file, place, sequence, start_pos, seq): the fragments of each file in order."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        state, n = None, 0
        out: list[tuple] = []

        def given() -> dict:
            cols = dict(zip(("file", "place", "sequence", "start_pos", "seq"), map(list, zip(*out, strict=True)), strict=True))
            out.clear()
            return cols

        def put(found: Iterator[tuple[str, int, str]]) -> None:
            nonlocal n
            for header, start, bases in found:
                out.append((state.file, n, header, start, bases))
                n += 1

        for batch in it:
            for file, text in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if state is None or state.file != file:
                    if state is not None:
                        put(state.end())
                    state, n = FastaState(file, min_length), 0
                put(state.line(text))
                if len(out) >= 5000:
                    yield given()
        if state is not None:
            put(state.end())
        if out:
            yield given()

    return by_arrow(lines.repartition("file").sortWithinPartitions("file", "line").select("file", "value"), run, SCHEMA)


def read_sequences(spark: SparkSession, paths: list[str], min_length: int = MIN_LENGTH, skip: int = 0, use: int | None = None, strict: bool = False) -> DataFrame:
    """(read_id, source, fragment_id, sequence, start_pos, seq, comment, qual, tag) of files of one format; fragment ids start at 0
    in each file, read_id tells files apart too. Reads under min_length and FASTQ reads with N are left out. skip and use
    count valid records of each file. A FASTA fragment's tag is its source and fragment id."""
    kinds = {format_of(p) for p in paths}
    if len(kinds) != 1:
        raise ValueError("files of one format at a time")
    lines = numbered_lines(spark, paths)
    if kinds == {"fastq"}:
        rows = fastq_records(lines, strict).where((F.length("seq") >= min_length) & ~F.contains("seq", F.lit("N"))).withColumn("start_pos", F.lit(0).cast("long"))
    else:
        rows = fasta_fragments(lines, min_length).withColumns({"comment": F.lit(None).cast("string"), "qual": F.lit(None).cast("string")})
    numbered = sums_before(cut(rows.withColumn("one", F.lit(1).cast("long")), "reads"), ["file"], "place", "one", "fragment_id")
    if skip or use is not None:
        numbered = numbered.where(F.col("fragment_id") >= skip)
        numbered = numbered if use is None else numbered.where(F.col("fragment_id") < skip + use)
        numbered = numbered.withColumn("fragment_id", F.col("fragment_id") - skip)
    files = numbered.select("file").distinct().withColumn("number", F.row_number().over(Window.orderBy("file")).cast("long"))  # a row a file
    source = source_of(F.col("file"))
    tag = F.concat_ws(":", source, F.col("fragment_id").cast("string")) if kinds == {"fasta"} else F.lit(None).cast("string")
    read_id = F.shiftleft("number", 40) + F.col("fragment_id")
    return numbered.join(files, "file").select(read_id.alias("read_id"), source.alias("source"), "fragment_id", "sequence", "start_pos", "seq", "comment", "qual", tag.alias("tag"))


def with_read_id(reads: DataFrame) -> DataFrame:
    """reads with a read_id, made from source and fragment_id where there is none."""
    return reads if "read_id" in reads.columns else reads.withColumn("read_id", F.xxhash64("source", "fragment_id"))


def write_fastq(reads: DataFrame, path: str, compression: str = "none") -> None:
    """Reads, as `read_sequences` gives them, as FASTQ records: the name from `sequence` (or `name`), an empty comment where there is
    none, the highest usual quality where there is none. compression: none, gzip or bzip2."""
    name = F.col("sequence" if "sequence" in reads.columns else "name")
    optional = lambda c: F.col(c) if c in reads.columns else F.lit(None).cast("string")
    qual = F.coalesce(optional("qual"), F.repeat(F.lit("I"), F.length("seq")))
    record = F.concat(F.lit("@"), F.coalesce(name, F.lit("")), F.lit("\n"), F.col("seq"), F.lit("\n+"), F.coalesce(optional("comment"), F.lit("")), F.lit("\n"), qual)
    reads.select(record.alias("value")).write.option("compression", compression).text(path)
