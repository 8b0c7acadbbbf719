"""Further layers behind HTTP: a token classifier's service and a language model.

Each is optional and safe to lose: a failure gives null and the text stays as the layer before left it. Tasks call the
services themselves, with a bounded number of requests under way and a breaker for each task.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from threading import Lock

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# Limits of the layers.
NER_TIMEOUT, NER_CHARS = 3.0, 20_000
LLM_TIMEOUT, LLM_CHARS = 60.0, 6_000
FAILURES, OPEN_SECONDS = 3, 30.0


@dataclass
class Breaker:
    """Closed until three failures follow each other; open for 30 seconds; then one trial."""

    clock: Callable[[], float] = time.monotonic
    state: dict[str, list] = field(default_factory=dict)

    def allows(self, url: str) -> bool:
        failures, opened = self.state.get(url, [0, None])
        if opened is None:
            return True
        if self.clock() - opened < OPEN_SECONDS:
            return False
        self.state[url] = [FAILURES - 1, None]
        return True

    def succeeded(self, url: str) -> None:
        self.state.pop(url, None)

    def failed(self, url: str) -> None:
        n = self.state.get(url, [0, None])[0] + 1
        self.state[url] = [n, self.clock() if n >= FAILURES else None]


def post(url: str, body: dict, timeout: float, key: str | None = None) -> dict:
    head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    request = urllib.request.Request(url, json.dumps(body).encode(), head)
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.loads(answer.read())


def healthy(url: str, timeout: float = NER_TIMEOUT) -> bool:
    try:
        with urllib.request.urlopen(f"{url.rstrip('/')}/health", timeout=timeout) as answer:
            return answer.status == 200
    except OSError:
        return False


#: Requests of a task that are under way at once, tries of one, and the wait before a further one.
AT_ONCE, TRIES, WAIT = 4, 2, 0.2


class Course:
    """A task's requests: at most ``at_once`` under way, answers in the order of the rows, each row asked up to ``tries`` times.

    Before the first row the service is probed and, if it answers, warmed up by one request whose answer is not used. A
    service that does not answer is left out for the whole task. Every row has a note: none, or why it has no answer.
    """

    def __init__(self, url: str, call: Callable[[str], object], at_once: int = AT_ONCE, tries: int = TRIES, wait: float = WAIT, probe: Callable[[], bool] | None = None, warm_up: str | None = None, breaker: Breaker | None = None):
        self.url, self.call, self.at_once, self.tries, self.wait = url, call, at_once, tries, wait
        self.probe, self.warm_up = probe, warm_up
        self.breaker, self.lock = breaker or Breaker(), Lock()

    def _one(self, text: str) -> tuple[object, str | None, int]:
        for n in range(1, self.tries + 1):
            with self.lock:
                if not self.breaker.allows(self.url):
                    return None, "breaker open", n - 1
            try:
                answer = self.call(text)
            except Exception as e:  # any failure of a layer leaves the text as it is
                with self.lock:
                    self.breaker.failed(self.url)
                note = f"failed: {type(e).__name__}"
            else:
                with self.lock:
                    self.breaker.succeeded(self.url)
                return answer, None, n
            if n < self.tries:
                time.sleep(self.wait * n)
        return None, note, self.tries

    def answers(self, texts: Iterable[str | None]) -> Iterator[tuple[object, str | None, int]]:
        """(answer, note, tries) for each text; null and empty ones are not asked."""
        if self.probe is not None and not self.probe():
            yield from ((None, "skipped: no answer to the probe" if t else None, 0) for t in texts)
            return
        with ThreadPoolExecutor(self.at_once) as pool:
            if self.warm_up is not None:
                pool.submit(self._one, self.warm_up).result()
            under_way: deque = deque()
            for t in texts:
                under_way.append(pool.submit(self._one, t) if t else None)
                if len(under_way) > self.at_once:
                    f = under_way.popleft()
                    yield f.result() if f else (None, None, 0)
            while under_way:
                f = under_way.popleft()
                yield f.result() if f else (None, None, 0)


def asked(df: DataFrame, text_col: str, out: str, kind: T.DataType, url: str, call: Callable[[str], object], **options) -> DataFrame:
    """The rows with ``out`` (what the service gives, null if nothing), ``out``_note and ``out``_tries, in the order of their partition.

    Each task keeps a bounded number of requests under way and one breaker, whose state the next task does not know.
    """
    added = T.StructType([T.StructField(out, kind), T.StructField(f"{out}_note", T.StringType()), T.StructField(f"{out}_tries", T.IntegerType())])
    kept = [f for f in df.schema.fields if f.name not in added.names]
    schema = T.StructType([*kept, *added.fields])
    arrow = to_arrow_type(kind)

    def run(batches):
        course = Course(url, call, **options)
        held: deque = deque()

        def texts():
            for b in batches:
                held.append(b)
                yield from b.column(0).to_pylist()

        found: list = []
        for answer in course.answers(texts()):
            found.append(answer)
            while held and len(found) >= held[0].num_rows:
                yield _with_answers(held.popleft(), found, arrow, added.names)
        for b in held:
            yield _with_answers(b, found, arrow, added.names)

    return df.select(F.col(text_col).alias("__asked"), *[F.col(f.name) for f in kept]).mapInArrow(run, schema)


def _with_answers(batch: pa.RecordBatch, found: list, kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    n = batch.num_rows
    answers, found[:] = found[:n], found[n:]
    columns = [pa.array([a[i] for a in answers], t) for i, t in enumerate((kind, pa.string(), pa.int32()))]
    return pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], names=[*batch.schema.names[1:], *names])


def notes(df: DataFrame, out: str) -> DataFrame:
    """How many rows have an answer, and for which reasons others have none: note (null for an answer), rows, tries."""
    return df.groupBy(F.col(f"{out}_note").alias("note")).agg(F.count("*").alias("rows"), F.sum(f"{out}_tries").cast("long").alias("tries"))


def ner_layer(df: DataFrame, url: str, text_col: str = "redacted", send: Callable = post, key: str | None = None, **options) -> DataFrame:
    """Column ner: the text after the service, whose first 20 000 characters it sees; null if the layer failed. ``options`` are those of ``Course``."""

    def call(text: str) -> str:
        answer = send(f"{url.rstrip('/')}/redact", {"text": text[:NER_CHARS]}, NER_TIMEOUT, key)
        if not isinstance(answer, dict) or not isinstance(answer.get("redacted"), str):
            raise ValueError("no text in the answer")
        return answer["redacted"] + text[NER_CHARS:]

    done = asked(df, text_col, "ner", T.StringType(), url, call, **options)
    return done.withColumn("ner", F.when(F.col(text_col) == "", "").otherwise(F.col("ner")))


def llm_layer(df: DataFrame, ask: Callable[[str], list], url: str = "llm", text_col: str = "redacted", **options) -> DataFrame:
    """Column candidates: what ``ask`` finds in the first 6000 characters; null if the layer failed."""

    def call(text: str) -> list[str]:
        found = ask(text[:LLM_CHARS])
        if not isinstance(found, list):
            raise ValueError("no list in the answer")
        return [c for c in found if isinstance(c, str)]

    return asked(df, text_col, "candidates", T.ArrayType(T.StringType()), url, call, **options)
