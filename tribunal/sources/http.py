"""Judges behind HTTP: one request per item, in parallel by partition."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class JudgeError(RuntimeError):
    """A judge didn't answer as it should."""


def extract(body, path: str) -> str:
    """The text at a dotted path, whose whole numbers index lists."""
    for step in path.split("."):
        try:
            body = body[int(step)] if isinstance(body, list) else body[step]
        except (KeyError, IndexError, ValueError, TypeError) as e:
            raise JudgeError(f"no {step!r} of {path!r} in the reply") from e
    if not isinstance(body, str):
        raise JudgeError(f"{path!r} isn't a text")
    return body


@dataclass(frozen=True)
class HttpJudge:
    """template: the JSON body, in which {{system}}, {{user}} and {{model}} stand for JSON texts without their quotes."""

    url: str
    template: str
    path: str
    model: str = ""
    headers: dict = field(default_factory=dict)
    timeout: float = 60.0

    def body(self, system: str, user: str) -> bytes:
        out, values = [], {"system": system, "user": user, "model": self.model}
        rest = self.template
        while "{{" in rest:  # from left to right, so that what was filled in isn't looked at again
            before, _, rest = rest.partition("{{")
            name, _, rest = rest.partition("}}")
            out += [before, json.dumps(values[name])[1:-1]]
        return "".join([*out, rest]).encode()

    def identity(self) -> str:
        """A digest of what a reply hangs on besides the prompt; headers (keys among them) are not in it."""
        return hashlib.sha256("\0".join((self.url, self.template, self.path, self.model)).encode()).hexdigest()

    def ask(self, system: str, user: str) -> str:
        request = urllib.request.Request(self.url, self.body(system, user), {"Content-Type": "application/json", **self.headers})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:  # noqa: S310
                return extract(json.loads(reply.read()), self.path)
        except urllib.error.HTTPError as e:
            raise JudgeError(f"status {e.code}: {e.read()[:300].decode('utf-8', 'replace')}") from e
        except (OSError, ValueError) as e:
            raise JudgeError(str(e)) from e


_CHAT = '{"model": "{{model}}", "max_tokens": 16, "temperature": 0, "messages": [{"role": "system", "content": "{{system}}"}, {"role": "user", "content": "{{user}}"}]}'
_MESSAGES = '{"model": "{{model}}", "max_tokens": 16, "system": "{{system}}", "messages": [{"role": "user", "content": "{{user}}"}]}'


#: Where a local service with a chat completions interface listens by default.
LOCAL = "http://localhost:11434/v1"


def joined(base: str, path: str) -> str:
    """path after the base's own path, whose version isn't repeated, and before its query string."""
    head, mark, query = base.partition("?")
    head = head.rstrip("/")
    return head + (path.removeprefix("/v1") if head.endswith("/v1") else path) + mark + query


def chat_completions(base: str = LOCAL, model: str = "", key: str = "", **more) -> HttpJudge:
    """Services with a chat completions interface, local ones among them."""
    return HttpJudge(joined(base or LOCAL, "/v1/chat/completions"), _CHAT, "choices.0.message.content", model, {"Authorization": f"Bearer {key}"} if key else {}, **more)


def messages(base: str, model: str, key: str = "", version: str = "2023-06-01", **more) -> HttpJudge:
    """Services with a messages interface; no temperature is sent."""
    return HttpJudge(joined(base, "/v1/messages"), _MESSAGES, "content.0.text", model, {"x-api-key": key, "anthropic-version": version}, **more)


def custom(url: str, template: str, path: str, headers: list[str] = (), **more) -> HttpJudge:
    """headers: `Key: value` lines, cut at the first colon."""
    if bad := [h for h in headers if ":" not in h]:
        raise ValueError(f"a header needs a colon: {bad[0]!r}")
    return HttpJudge(url, template, path, headers={k.strip(): v.strip() for k, _, v in (h.partition(":") for h in headers)}, **more)


def asked(prompts: DataFrame, judge: HttpJudge, parallel: int = 8) -> DataFrame:
    """prompts (item_id, system, user) with the judge's reply as `raw`; `parallel` requests run at a time, and a failed one fails the job."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"item_id": pdf["item_id"], "raw": [judge.ask(s, u) for s, u in zip(pdf["system"], pdf["user"], strict=True)]})

    return prompts.select("item_id", "system", "user").repartition(parallel).mapInPandas(run, "item_id string, raw string")


REPLIES = "key string, raw string"


def _files(path: str):
    """The file system of a path, which the driver and all executors reach, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def logging_task(judge: HttpJudge, log: str, round_: str, partition: int, every: int, retries: int, wait: float):
    """A task that asks for its rows (key, system, user), and logs every few replies; what an earlier attempt of it has logged isn't asked again."""
    from pyarrow import Table, fs, parquet

    files, folder = _files(f"{log}/replies/{round_}/{partition:06d}")

    def write(rows: list[tuple[str, str]], number: int) -> None:
        table = Table.from_pydict({"key": [k for k, _ in rows], "raw": [r for _, r in rows]})
        parquet.write_table(table, f"{folder}/_{number:06d}", filesystem=files)
        files.move(f"{folder}/_{number:06d}", f"{folder}/{number:06d}.parquet")  # whole or not there

    def patient(system: str, user: str) -> str:
        for k in range(retries + 1):
            try:
                return judge.ask(system, user)
            except JudgeError:
                if k == retries:
                    raise
                time.sleep(wait * 2**k)

    def run(batches):
        files.create_dir(folder, recursive=True)
        old = [f.path for f in files.get_file_info(fs.FileSelector(folder)) if f.path.endswith(".parquet")]
        done = {k for f in old for k in parquet.read_table(f, filesystem=files)["key"].to_pylist()}
        some, number, asked_ = [], len(old), 0
        try:
            for pdf in batches:
                for key, system, user in zip(pdf["key"], pdf["system"], pdf["user"], strict=True):
                    if key not in done:
                        some.append((key, patient(system, user)))
                        asked_ += 1
                    if len(some) >= every:
                        write(some, number)
                        some, number = [], number + 1
        finally:
            if some:
                write(some, number)
        yield pd.DataFrame({"n": [asked_]})

    return run


def replies(spark: SparkSession, log: str) -> DataFrame:
    """key and raw of all that was logged, each key once."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema(REPLIES).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(f"{log}/replies")
    except AnalysisException:  # nothing was logged yet
        return spark.createDataFrame([], REPLIES)
    return rows.groupBy("key").agg(F.min("raw").alias("raw"))


def asked_once(prompts: DataFrame, judge: HttpJudge, log: str, parallel: int = 8, every: int = 16, retries: int = 2, wait: float = 1.0) -> DataFrame:
    """prompts (system, user and more) with the judge's reply as `raw`, from the log of replies under `log`, where what is missing is asked for first.

    Equal prompts are asked for once, and those that the log has for this judge not at all: not in another run, not when the result is computed again, and
    not by the second attempt of a task that got lost after it had logged them (it logs every few replies). `parallel` tasks ask at a time; a request that
    fails `retries` times more fails the job, and what was logged by then stays. The log must be on storage that all executors reach.
    """
    import uuid

    spark, round_ = prompts.sparkSession, uuid.uuid4().hex
    own = prompts.withColumn("__key", F.sha2(F.concat_ws("\0", F.lit(judge.identity()), "system", "user"), 256))
    missing = own.select(F.col("__key").alias("key"), "system", "user").dropDuplicates(["key"]).join(replies(spark, log), "key", "left_anti")

    def ask(batches):
        from pyspark import TaskContext

        yield from logging_task(judge, log, round_, TaskContext.get().partitionId(), every, retries, wait)(batches)

    missing.repartition(parallel, "key").mapInPandas(ask, "n long").agg(F.sum("n")).collect()  # by key, so that a second attempt gets the same rows
    return own.join(replies(spark, log).withColumnRenamed("key", "__key"), "__key").drop("__key")


def compact(spark: SparkSession, log: str, files: int = 1) -> None:
    """Many small files of the log become few. One caller at a time; nobody must be asking meanwhile."""
    old = [r[0] for r in spark.read.schema(REPLIES).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(f"{log}/replies").select(F.col("_metadata.file_path")).distinct().collect()]
    replies(spark, log).coalesce(files).write.mode("append").parquet(f"{log}/replies/compacted")
    for path in old:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, False)
