"""Reading and writing passages, commentary, embeddings and the other files of a corpus."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ref_parts

PASSAGE = T.StructType([T.StructField(n, T.StringType()) for n in ("ref", "text", "commentary", "arabic")])


def read_passages(spark: SparkSession, path: str, with_commentary: bool = True, commentary_field: str = "commentary") -> DataFrame:
    """JSON lines to (row_idx, ref, text, commentary, arabic); blank lines are skipped, absent or null optional fields are empty.

    Broken JSON and a missing ref or text raise. Without ``with_commentary`` that field isn't parsed.
    ``row_idx`` numbers the lines of a file as they come; over several files it only keeps their order.
    """
    fields = ["ref", "text", *([commentary_field] if with_commentary else []), "arabic"]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in fields])
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path).withColumn("row_idx", F.monotonically_increasing_id())
    must = lambda c: F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"a passage has no {c}")))
    commentary = F.coalesce(F.col(commentary_field), F.lit("")) if with_commentary else F.lit("")
    return rows.select("row_idx", must("ref").alias("ref"), must("text").alias("text"), commentary.alias("commentary"), F.coalesce("arabic", F.lit("")).alias("arabic"))


def choose_corpus(full: str, sample: str, override: str | None = None, exists: Callable[[str], bool] = os.path.exists) -> str:
    """The corpus to open: an override, else the full one if it is there, else the sample."""
    return override or (full if exists(full) else sample)


def write_passages(passages: DataFrame, path: str) -> None:
    """JSON lines in order of chapter and verse; other scripts are written as they are. The committer makes it appear whole or not at all."""
    ordered(passages).drop("row_idx").write.mode("overwrite").json(path)


def ordered(passages: DataFrame) -> DataFrame:
    """In order of chapter and verse."""
    at = ref_parts(F.col("ref"))
    return passages.orderBy(at["chapter"], at["verse"], "ref")


def page(passages: DataFrame, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` passages in order, with n, the place of each among all."""
    own = ordered(passages).offset((number - 1) * size).limit(size)
    at = ref_parts(F.col("ref"))
    place = F.row_number().over(Window.partitionBy().orderBy(at["chapter"], at["verse"], "ref"))  # of one page's rows
    return own.withColumn("n", (place + (number - 1) * size).cast("long"))


def with_names(rows: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with ``name`` of a dimension ``names`` (``key``, ``name``); empty where it has none. Of several names of a key the largest."""
    once = names.groupBy(key).agg(F.max(name).alias(name))
    return rows.join(once, key, "left").withColumn(name, F.coalesce(name, F.lit("")))


def duplicate_refs(passages: DataFrame) -> DataFrame:
    """(ref, n) of the refs that come more than once."""
    return passages.groupBy("ref").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Lines "chapter|file name" to (position, chapter, file); blanks are skipped."""
    lines = spark.read.text(path).withColumn("position", F.monotonically_increasing_id()).where(F.trim("value") != "")
    p = F.split("value", r"\|", 2)
    return lines.select("position", F.trim(p.getItem(0)).cast("int").alias("chapter"), F.trim(p.getItem(1)).alias("file"))


def read_translation(spark: SparkSession, path: str) -> DataFrame:
    """Nested JSON data.surahs[].ayahs[] to (chapter, verse, ref, text)."""
    ayah = T.ArrayType(T.StructType([T.StructField("numberInSurah", T.IntegerType()), T.StructField("text", T.StringType())]))
    surah = T.ArrayType(T.StructType([T.StructField("number", T.IntegerType()), T.StructField("ayahs", ayah)]))
    schema = T.StructType([T.StructField("data", T.StructType([T.StructField("surahs", surah)]))])
    return flatten_translation(spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).select("data.surahs"))


def flatten_translation(nested: DataFrame) -> DataFrame:
    """(surahs: array of chapters with arrays of verses) to (chapter, verse, ref, text)."""
    chapters = nested.select(F.explode("surahs").alias("s")).select(F.col("s.number").alias("chapter"), F.explode("s.ayahs").alias("a"))
    return chapters.select("chapter", F.col("a.numberInSurah").alias("verse"), F.concat_ws(":", "chapter", F.col("a.numberInSurah")).alias("ref"), F.col("a.text").alias("text"))


def read_documents(spark: SparkSession, path: str, extract: Callable[[bytes], list[str | None]]) -> DataFrame:
    """(path, text, error) of binary files: ``extract`` gives the texts of a file's pages, which are joined by line ends; a null page is empty.

    A file that can't be read has its error and no text, and doesn't stop the others.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, content in zip(b["path"], b["content"], strict=True):
                try:
                    out.append((p, "\n".join(x or "" for x in extract(bytes(content))), None))
                except Exception as e:  # noqa: BLE001
                    out.append((p, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "text", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string, error string")


def page_texts(content: bytes) -> list[str | None]:
    """Pages of a plain text file: form feeds divide them."""
    return list(content.decode("utf-8", "replace").split("\f"))


class _PageText(HTMLParser):
    """Text of an HTML page: a line for each block, without scripts and styles."""

    BLOCKS = frozenset("address article aside blockquote br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
    SILENT = frozenset(["script", "style", "template", "noscript"])

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out, self.quiet = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.quiet += tag in self.SILENT
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.quiet = max(0, self.quiet - (tag in self.SILENT))
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.quiet:
            self.out.append(data.replace("\n", " "))


def html_texts(content: bytes) -> list[str | None]:
    """The one page of an HTML file, for ``read_documents``. Other formats need an extractor of their own."""
    page = _PageText()
    page.feed(content.decode("utf-8", "replace"))
    page.close()
    lines = (" ".join(x.split()) for x in "".join(page.out).split("\n"))
    return ["\n".join(x for x in lines if x)]


# Embeddings


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(row_idx, ref, embedding)."""
    return spark.read.parquet(path).select(F.col("row_idx").cast("long"), F.col("ref").cast("string"), F.col("embedding").cast("array<float>"))


def embed_passages(passages: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = 32, tries: int = 4, wait: Callable[[float], None] | None = None) -> DataFrame:
    """(row_idx, ref, embedding) with unit vectors. ``embed`` takes up to ``batch`` texts; a failing call is tried again after 1, 2, 4 ... seconds."""
    import time

    pause = wait or time.sleep

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for b in batches:
            for i in range(0, len(b), batch):
                part = b.iloc[i : i + batch]
                for n in range(tries):
                    try:
                        vectors = np.asarray(embed(part["text"].tolist()), dtype=np.float32)
                        break
                    except Exception:
                        if n == tries - 1:
                            raise
                        pause(2.0**n)
                norm = np.linalg.norm(vectors, axis=1, keepdims=True)
                vectors = vectors / np.where(norm == 0, 1, norm)
                yield pd.DataFrame({"row_idx": part["row_idx"].to_numpy(), "ref": part["ref"].to_numpy(), "embedding": list(vectors)})

    return passages.select("row_idx", "ref", "text").mapInPandas(run, "row_idx long, ref string, embedding array<float>")


def write_embeddings(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").option("compression", "zstd").parquet(path)


# Commentary


class CommentaryStore:
    """Commentary by ref, as a table sorted by ref, so that a lookup reads few row groups."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = spark.read.parquet(path).select("ref", "commentary")

    @property
    def refs(self) -> DataFrame:
        """Refs that have commentary."""
        return self.table.where(F.length("commentary") > 0).select("ref")

    def rows(self, ref: str) -> DataFrame:
        """(ref, commentary) of one ref."""
        return self.table.where(F.col("ref") == ref)

    def get(self, ref: str) -> str:
        row = self.rows(ref).select("commentary").first()
        return row["commentary"] if row else ""

    def has(self, ref: str) -> bool:
        return not self.refs.where(F.col("ref") == ref).isEmpty()

    def __len__(self) -> int:
        return self.refs.count()

    @staticmethod
    def build(passages: DataFrame, path: str) -> dict[str, int]:
        """Write (ref, commentary); a ref that comes twice raises. Returns the numbers of rows and of rows with commentary."""
        twice = duplicate_refs(passages).first()
        if twice:
            raise ValueError(f"ref {twice['ref']!r} is not unique")
        rows = passages.select("ref", F.coalesce("commentary", F.lit("")).alias("commentary"))
        rows.repartitionByRange("ref").sortWithinPartitions("ref").write.mode("overwrite").option("compression", "zstd").parquet(path)
        return build_counters(passages.sparkSession.read.parquet(path)).first().asDict()


def build_counters(passages: DataFrame) -> DataFrame:
    return passages.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.length("commentary") > 0).alias("with_commentary"))


def chapter_report(passages: DataFrame, chapters: int = 114) -> DataFrame:
    """(chapter, verses) for all chapters, zeros included. ``passages``: chapter."""
    all_ = passages.sparkSession.range(1, chapters + 1).select(F.col("id").cast("int").alias("chapter"))
    n = passages.groupBy("chapter").agg(F.count(F.lit(1)).alias("verses"))
    return all_.join(n, "chapter", "left").select("chapter", F.coalesce("verses", F.lit(0)).alias("verses"))
