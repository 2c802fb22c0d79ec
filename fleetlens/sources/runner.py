"""Running query texts over the business tables and storing what they return."""

from __future__ import annotations

import hashlib
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping
from functools import partial
from itertools import batched
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark import InheritableThread
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.model import Tables
from fleetlens.sources.admission import RefusedText, admitted
from fleetlens.sources.checkpoints import checkpoint_dir
from fleetlens.sources.results import (
    GENERATED,
    OUTCOME_SCHEMA,
    ROW_SCHEMA,
    TRUTH,
    outcome_row,
    outcome_table,
    result_rows,
)

TIME_LIMIT = 600.0  # seconds for one text
CONCURRENT = 4  # texts that run at the same time
BATCH = 1000  # outcomes that the driver holds before it writes them

GRACE = 20.0  # seconds in which a stopped text may end by itself

#: What is done with a query's name and result.
Action = Callable[[str, DataFrame], Any]


class QueryRunner:
    """Runs SQL texts in a session of its own, where the tables are views.

    `open_tables` takes the session and returns the tables; the caller's views and
    settings stay untouched.  Only queries over these views run, made of the relational
    operators and built-in functions that `admission` lists: no commands, no programs, no
    methods of the JVM, no files named as tables, no functions of a session's own.

    A text that runs longer than `time_limit` seconds is stopped for good: its jobs are
    cancelled, those that it would start later are refused, and one that is stuck between
    jobs for `grace` seconds more, in planning say, is left behind.  None is no limit.  Up to
    `concurrent` texts run at once.
    """

    def __init__(
        self,
        spark: SparkSession,
        open_tables: Callable[[SparkSession], Tables],
        time_limit: float | None = TIME_LIMIT,
        concurrent: int = CONCURRENT,
        grace: float = GRACE,
    ):
        self.spark = spark.newSession()
        self.time_limit, self.concurrent, self.grace = time_limit, concurrent, grace
        # A new session starts from the defaults of the context.
        for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
            self.spark.conf.set(key, spark.conf.get(key))
        self.spark.conf.set("spark.sql.runSQLOnFiles", "false")
        tables = dict(open_tables(self.spark).items())
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        self.views = frozenset(name.lower() for name in tables)

    def query(self, text: str) -> DataFrame:
        return admitted(self.spark, _statement(text), self.views)

    def store(
        self, queries: Iterable[tuple[str, int, str, str | DataFrame]], directory: str
    ) -> tuple[DataFrame, DataFrame]:
        """Run (model, query_id, side, query) entries; returns (outcomes, rows).

        A query is an SQL text or a DataFrame.  Each result is written by the executors
        below `directory` and counts as executed only once that has worked.  A query
        used more than once runs once.  The driver holds one batch of texts and outcomes;
        of earlier texts it keeps a name of fixed size."""
        run = f"{directory}/run-{uuid.uuid4().hex}"
        names: dict[str | int, str] = {}
        known: dict[str, tuple[str | None, list[str]]] = {}
        for batch in batched(queries, BATCH):
            new = {}
            for *_, query in batch:
                key = _key(query)
                if key not in names:
                    names[key] = uuid.uuid4().hex
                    new[names[key]] = query
            known |= {
                name: (error, columns or [])
                for name, (error, columns) in self.run_all(new, partial(_keep, run)).items()
            }
            outcomes = [
                (*outcome_row(m, q, side, known[names[_key(query)]][1], known[names[_key(query)]][0]),
                 names[_key(query)])
                for m, q, side, query in batch
            ]
            schema = T.StructType([*OUTCOME_SCHEMA.fields, T.StructField("result", T.StringType())])
            self.spark.createDataFrame(outcomes, schema).write.mode("append").parquet(
                f"{run}/outcomes"
            )
        if not names:
            return outcome_table(self.spark, []), self.spark.createDataFrame([], ROW_SCHEMA)
        outcomes = self.spark.read.parquet(f"{run}/outcomes")
        return outcomes.select(*OUTCOME_SCHEMA.names), self._read(outcomes, run, known)

    def run_all(
        self, queries: Mapping[str, str | DataFrame], action: Action
    ) -> dict[str, tuple[str | None, Any]]:
        """What `action` returns for each query's name and result, or the error, by name.

        Several queries run at once, each in a job group of its own with the time limit.
        What keeps the runner itself from running them is raised."""
        found: dict[str, tuple[str | None, Any]] = {}
        broken: list[Exception] = []
        waiting: Iterator[tuple[str, str | DataFrame]] = iter(list(queries.items()))
        lock = threading.Lock()

        def work() -> None:
            while True:
                with lock:
                    entry = next(waiting, None)
                if entry is None:
                    return
                try:
                    found[entry[0]] = self._run_one(*entry, action)
                except Exception as error:
                    broken.append(error)
                    return

        # Each thread has local properties of its own, so a job group is one text's.
        threads = [
            InheritableThread(target=work, session=self.spark)
            for _ in range(min(self.concurrent, len(queries)))
        ]
        for thread in threads:
            thread.start()
        for thread in threads:
            thread.join()
        if broken:
            raise broken[0]
        return found

    def _run_one(
        self, name: str, query: str | DataFrame, action: Action
    ) -> tuple[str | None, Any]:
        """Error and outcome of a query that runs in a thread of its own."""
        group, found = f"text-{uuid.uuid4().hex}", []

        def run() -> None:
            try:
                found.append(self._done(name, query, action, group))
            except Exception as error:  # of neither Spark nor the rules for texts
                found.append((f"the text could not be run: {error!r}", None))

        thread = InheritableThread(target=run, session=self.spark)
        thread.daemon = True
        thread.start()
        thread.join(self.time_limit)
        if not thread.is_alive():
            return found[0] if found else ("the text could not be run", None)
        end = time.monotonic() + self.grace
        while thread.is_alive() and time.monotonic() < end:
            self._stop(group)  # again each time: a broadcast has jobs of its own
            thread.join(min(1.0, self.grace))
        said = found[0][0] if found and found[0][0] else "no answer to the cancellation"
        return f"stopped after {self.time_limit:g} seconds: {said}", None

    def _stop(self, group: str) -> None:
        self.spark.interruptTag(group)
        self.spark.sparkContext._jsc.sc().cancelJobGroupAndFutureJobs(group)

    def _done(
        self, name: str, query: str | DataFrame, action: Action, group: str
    ) -> tuple[str | None, Any]:
        self.spark.addTag(group)
        self.spark.sparkContext.setJobGroup(group, "query text", interruptOnCancel=True)
        try:
            return None, action(name, self.query(query) if isinstance(query, str) else query)
        except PySparkException as error:
            return error.getMessage() or str(error), None
        except Py4JJavaError as error:
            return str(error.java_exception), None
        except RefusedText as error:
            return str(error), None
        finally:
            self.spark.removeTag(group)

    def _read(
        self, outcomes: DataFrame, run: str, known: Mapping[str, tuple[str | None, list[str]]]
    ) -> DataFrame:
        """Stored rows with the (model, query, side) each result was run for."""
        if all(error is not None for error, _ in known.values()):
            return self.spark.createDataFrame([], ROW_SCHEMA)
        schema = T.StructType(
            [ROW_SCHEMA["row_no"], ROW_SCHEMA["cells"], T.StructField("result", T.StringType())]
        )
        uses = outcomes.filter("ok").select("model", "query_id", "side", "result")
        stored = self.spark.read.schema(schema).parquet(f"{run}/rows")
        return stored.join(uses, "result").select(*ROW_SCHEMA.names)


def _statement(text: str) -> str:
    """What is run of a text: without white space around it and the semicolon at its end."""
    return text.strip().removesuffix(";")


def _key(query: str | DataFrame) -> str | int:
    """Texts that run as the same statement have equal keys of fixed size; a DataFrame is
    itself."""
    if isinstance(query, str):
        return hashlib.sha256(_statement(query).encode()).hexdigest()
    return id(query)


def _keep(run: str, name: str, result: DataFrame) -> list[str]:
    """Write a result to its own folder of a run; its columns."""
    rows = result_rows(result, "", 0, "").select("row_no", "cells")
    rows.write.parquet(f"{run}/rows/result={name}")
    return result.columns


def _observed_rows(name: str, result: DataFrame) -> int:
    """Run a query to its last row and column; the tasks count the rows on the way."""
    seen = Observation(name)
    result.observe(seen, F.count(F.lit(1)).alias("n_rows")).write.format("noop").mode(
        "overwrite"
    ).save()
    return seen.get["n_rows"]


def row_counts(
    spark: SparkSession,
    open_tables: Callable[[SparkSession], Tables],
    queries: Mapping[int, str | DataFrame],
    concurrent: int = 2 * CONCURRENT,
    all_or_none: bool = False,
) -> DataFrame:
    """query_id, n_rows, error: how many rows each query of a catalogue returns.

    Every query runs whole, however long, in jobs of its own, and counts as it runs: no query
    is planned together with others and none is read twice.  A query is a text, or a DataFrame
    such as a report, whose ranks need no window over the whole table.  Give tables that are
    stored; bound ones would be derived again by each query.  A query that fails has its error
    and no count; with `all_or_none`, it is raised instead."""
    found = QueryRunner(spark, open_tables, time_limit=None, concurrent=concurrent).run_all(
        {str(number): query for number, query in queries.items()}, _observed_rows
    )
    failed = [f"query {number}: {error}" for number, (error, _) in found.items() if error is not None]
    if all_or_none and failed:
        raise RuntimeError(f"{len(failed)} queries have no count: {'; '.join(failed)}")
    schema = "query_id int, n_rows long, error string"
    rows = [(int(number), n_rows, error) for number, (error, n_rows) in found.items()]
    return spark.createDataFrame(rows, schema)


def score_texts(
    runner: QueryRunner,
    truth: Mapping[int, str | DataFrame],
    answers: Iterable[tuple[str, int, str]],
) -> tuple[DataFrame, DataFrame]:
    """Run and store the truth and the answers (model, query_id, sql) to score them.

    Returns (outcomes, rows) for `operators.compare.score_pairs`."""
    texts = (
        entry
        for model, number, sql in answers
        for entry in ((model, number, GENERATED, sql), (model, number, TRUTH, truth[number]))
    )
    return runner.store(texts, checkpoint_dir(runner.spark))
