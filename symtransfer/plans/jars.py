"""The whole way of archives: scan, match, transfer, mapping file, rewritten archive, sources."""

from __future__ import annotations

import logging
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import TransferConfig
from ..operators.select import with_unmatched
from ..sinks import external
from ..sinks.jar import rewrite_jar
from ..sinks.tiny import write_tiny
from ..sources.jar import read_entry, read_jar
from ..sources.mappings import read_mapping
from .pipeline import TransferResult, match_lsh, transfer

LOG = logging.getLogger(__name__)
STAGES = ("parse target", "parse unmapped", "match", "review", "apply mapping", "write mapping", "decompile")


class Cancelled(RuntimeError):
    pass


class SkipAll(Exception):
    """Raised by `ask`: this class and all that follow keep their names."""


@contextmanager
def _cancelling(spark: SparkSession, cancelled: Callable[[], bool], every: float = 0.5) -> Iterator[None]:
    """Jobs that the block starts are cancelled soon after `cancelled` (asked from another thread) says so; the block then ends in Cancelled."""
    context, tag, done = spark.sparkContext, f"transfer-{uuid.uuid4().hex}", threading.Event()

    def watch() -> None:
        while not done.wait(every):
            if cancelled():
                context.cancelJobsWithTag(tag)

    watcher = threading.Thread(target=watch, daemon=True)
    context.addJobTag(tag)
    watcher.start()
    try:
        yield
    except Cancelled:
        raise
    except Exception as e:
        if cancelled():
            raise Cancelled("a running stage") from e
        raise
    finally:
        done.set()
        watcher.join()
        context.removeJobTag(tag)


def review(spark: SparkSession, unmatched: DataFrame, jar: str, ask: Callable[[str, str], str | None], show: Callable[[str], str] | None = None, cancelled: Callable[[], bool] = lambda: False) -> list[tuple[str, str]]:
    """Names that `ask` (class, source) gives to unmatched classes (u), one by one in order; a blank one or none keeps the class's own.

    show: path of a class file -> its source, such as `external.review_source` with a tool; without it, or if it fails, the
    source is empty. The classes are streamed, not gathered: their number is what a person can answer for.
    """
    given = []
    for row in unmatched.select("u").orderBy("u").toLocalIterator():
        if cancelled():
            raise Cancelled("review")
        source = ""
        data = read_entry(spark, jar, row.u + ".class").first() if show else None
        if data is not None:
            with tempfile.TemporaryDirectory() as folder:
                path = Path(folder, row.u.rpartition("/")[2] + ".class")
                path.write_bytes(data[0])
                source = show(str(path))
        try:
            name = ask(row.u, source)
        except SkipAll:
            break
        if name and name.strip():
            given.append((row.u, name))
    return given


def run(spark: SparkSession, config: TransferConfig, overrides: DataFrame | None = None, decompile: Callable[[str, str], list[str]] | None = None, cancelled: Callable[[], bool] = lambda: False, progress: Callable[[str, float], None] | None = None, ask: Callable[[str, str], str | None] | None = None, show: Callable[[str], str] | None = None) -> TransferResult:
    """Writes mappings.tiny and remapped.jar (and sources/) below config.output. overrides: entity_id, name, for unmatched classes.

    The mapping is written before the decompiler starts, so a failing tool loses nothing. cancelled is asked before each
    stage and, from another thread, while jobs run, which are then cancelled. ask, show: see `review`, for unmatched
    classes without an override. The result's frames stay persisted until its `release`.
    """
    config.validate()
    for path in (config.target, config.mapping, config.unmapped):
        if not Path(path).is_file():
            raise ValueError(f"not a file: {path}")
    out = Path(config.output)
    if out.exists() and not out.is_dir():
        raise ValueError(f"not a folder: {out}")
    kept: list[DataFrame] = []
    try:
        with _cancelling(spark, cancelled):
            return _run(spark, config, out, overrides, decompile, cancelled, progress, ask, show, kept)
    except BaseException:
        TransferResult(None, None, None, kept).release()
        raise


def _run(spark, config, out, overrides, decompile, cancelled, progress, ask, show, kept) -> TransferResult:
    def stage(k: int) -> None:
        if cancelled():
            raise Cancelled(STAGES[k])
        spark.sparkContext.setJobDescription(STAGES[k])
        if progress:
            progress(STAGES[k], k / len(STAGES))
        LOG.info("%s", STAGES[k])

    def keep(frame: DataFrame) -> DataFrame:
        kept.append(frame.persist())
        return kept[-1]

    p = config.parity
    stage(0)
    mapping = read_mapping(spark, config.mapping, p.unescape_names, p.nested_generics)
    right = read_jar(spark, config.target, p.drop_dynamic_classes, p.canonical_descriptors)
    stage(1)
    left = read_jar(spark, config.unmapped, p.drop_dynamic_classes, p.canonical_descriptors)
    left.entity, left.member = keep(left.entity), keep(left.member)
    stage(2)
    if overrides is None:
        overrides = spark.createDataFrame([], "entity_id string, name string")
    mapped = right.only(mapping.classes.select(F.col("from_name").alias("entity_id")))
    seen = Observation("match")
    best = keep(match_lsh(left, mapped, config))
    rows = with_unmatched(best, left.entity, config.threshold)
    rows.observe(seen, F.count(F.lit(1)).alias("classes"), F.count_if("matched").alias("matched")).write.format("noop").mode("overwrite").save()
    LOG.info("matched %d of %d classes", seen.get["matched"], seen.get["classes"])
    stage(3)
    if ask is not None:
        alone = rows.where(~F.col("matched")).join(overrides.select(F.col("entity_id").alias("u")), "u", "left_anti")
        given = review(spark, alone, config.unmapped, ask, show, cancelled)
        overrides = overrides.select("entity_id", "name").unionByName(spark.createDataFrame(given, "entity_id string, name string"))
    result = transfer(left, right, mapping.classes, mapping.members, overrides, config, best)
    result.match, result.classes, result.members, result.kept = keep(result.match), keep(result.classes), keep(result.members), kept
    stage(4)
    out.mkdir(parents=True, exist_ok=True)
    done = rewrite_jar(spark, config.unmapped, str(out / "remapped.jar"), result.classes, result.members)
    if done["collisions"]:
        LOG.warning("names given twice: %s", done["collisions"])
    stage(5)
    write_tiny(result.classes, result.members, str(out / "mappings.tiny"), mapping.namespaces)
    stage(6)
    if decompile is not None:
        external.clean(str(out / "sources"))
        decompile(str(out / "remapped.jar"), str(out / "sources"))
    if progress:
        progress("done", 1.0)
    return result
