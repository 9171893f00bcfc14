"""Sources: tables, uploaded files, sitemaps and settings."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.markdown import html_to_markdown


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def streamed_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a stream, whether it is one file or a folder of them."""
    path = f"{sf_dir}/{name}.parquet"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if fs.exists(at) and fs.getFileStatus(at).isFile():
        # A stream's path is taken for a folder unless it is a pattern; this one matches the file only.
        path = f"{sf_dir}/{name}.parque[t]"
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(path)


def uploaded_files(spark: SparkSession, path: str) -> DataFrame:
    """(filename, content) of the files below ``path``."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content")


def converted(files: DataFrame, converter: Callable[[Column], Column] | None = None) -> DataFrame:
    """(filename, md): HTML by the offline rules, or by ``converter``; other text as it is. Nothing is stored."""
    text = F.decode("content", "UTF-8")
    html = F.lower("filename").rlike(r"\.x?html?$")
    return files.select("filename", F.when(html, (converter or html_to_markdown)(text)).otherwise(text).alias("md"))


@dataclass(frozen=True)
class ConverterOptions:
    """What a converter of PDFs is asked for. A ladder's fallbacks are asked without formulas."""

    describe_pictures: bool = True
    formulas: bool = True


#: Makes markdown of a file's name and bytes, or raises.
Converter = Callable[[str, bytes, ConverterOptions], str]


def ladder(first: Converter, second: Converter | None = None, plain: Converter | None = None, tries: int = 3, wait: float = 1.0, pause: float = 0.5) -> Converter:
    """A converter that tries ``first`` some times, waiting longer each time, then ``second`` once, then ``plain``.

    The last one that fails raises. ``pause`` seconds pass between two calls of a worker.
    """

    def convert(name: str, content: bytes, options: ConverterOptions) -> str:
        fallback = replace(options, formulas=False)
        rungs = [(first, options)] * tries + [(c, fallback) for c in (second, plain) if c is not None]
        for k, (rung, asked) in enumerate(rungs):
            try:
                return rung(name, content, asked)
            except Exception:  # any failure is a reason to try the next rung
                if k == len(rungs) - 1:
                    raise
                time.sleep(wait * (k + 1) if k < tries - 1 else pause)
        raise ValueError("no converter")

    return convert


def converted_by(files: DataFrame, convert: Converter, options: ConverterOptions | None = None) -> DataFrame:
    """(filename, md, error) of (filename, content); a file that no rung converts has an error and no text."""
    asked = options or ConverterOptions()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, content in zip(batch.column("filename").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows.append((name, convert(name, content, asked), None))
                except Exception as e:  # one bad file must not stop the others
                    rows.append((name, None, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], ["filename", "md", "error"])

    return files.select("filename", "content").mapInArrow(run, "filename string, md string, error string")


def save_markdown(files: DataFrame, folder: str) -> None:
    """Writes the md of (filename, md) below ``folder``, partitioned by ``{stem}_output.md``."""
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    files.select(F.concat(stem, F.lit("_output.md")).alias("file"), F.col("md").alias("value")).write.partitionBy("file").mode("overwrite").text(folder)


def sitemap_urls(maps: DataFrame) -> DataFrame:
    """(base, url) of (base, xml), in order of the file; without a map (xml null) the base itself."""
    urls = F.when(F.col("xml").isNull(), F.array(F.regexp_replace("base", "/+$", ""))).otherwise(F.xpath("xml", F.lit("//loc/text()")))
    return maps.select("base", F.posexplode(urls).alias("pos", "url"))


@dataclass(frozen=True)
class Settings:
    """Limits of ingestion and search."""

    dims: int = 768
    chunk_tokens: int = 700
    soft_tokens: int = 350
    rerank_depth: int = 20
    use_reranker: bool = False
    use_openai_rerank: bool = False
    use_jina_rerank: bool = False
    jina_key: str = ""

    @classmethod
    def of(cls, env: Mapping[str, str]) -> Settings:
        whole = {k: int(env[k.upper()]) for k in ("dims", "chunk_tokens", "soft_tokens", "rerank_depth") if k.upper() in env}
        flags = {k: env[k.upper()].strip().lower() in ("1", "true", "yes", "y", "on") for k in ("use_reranker", "use_openai_rerank", "use_jina_rerank") if k.upper() in env}
        return cls(**whole, **flags, jina_key=env.get("JINA_KEY", ""))

    def depth(self, limit: int, asked: int | None = None) -> int:
        """Candidates fetched for a search of ``limit`` hits."""
        return asked or (self.rerank_depth if self.use_reranker else limit)
