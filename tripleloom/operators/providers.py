"""Models and embedders as operators on tables.

Calls to a model are expensive and may answer differently each time, so equal prompts are asked once and the answers are written to the shared
folder before anything reads them: no lost executor makes them be asked again.
"""

from __future__ import annotations

import importlib
import importlib.util
import json
import os
import threading
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripleloom.storage import small, written


def prompt_hash(instructions: Column, text: Column) -> Column:
    """The key of a prompt: SHA-256 of instructions and input with a zero character between."""
    return F.sha2(F.concat(F.coalesce(instructions, F.lit("")), F.lit("\0"), F.coalesce(text, F.lit(""))), 256)


class Model:
    """Gives rows with ``instructions`` and ``input`` a column ``completion``."""

    def complete(self, prompts: DataFrame) -> DataFrame:
        raise NotImplementedError


@dataclass
class Rules(Model):
    """A model that is a column expression of (instructions, input)."""

    rule: Callable[[Column, Column], Column]

    def complete(self, prompts: DataFrame) -> DataFrame:
        return prompts.withColumn("completion", self.rule(F.col("instructions"), F.col("input")))


@dataclass
class Replay(Model):
    """Answers recorded before, in a table (prompt_hash, completion); a prompt that was not recorded has a null completion."""

    recorded: DataFrame

    def complete(self, prompts: DataFrame) -> DataFrame:
        one = self.recorded.groupBy("prompt_hash").agg(F.min("completion").alias("completion"))
        keyed = prompts.withColumn("prompt_hash", prompt_hash(F.col("instructions"), F.col("input")))
        return keyed.join(small(one), "prompt_hash", "left").drop("prompt_hash")


class RateLimiter:
    """At most ``per_second`` calls begin in any second; shared by the threads of a worker."""

    def __init__(self, per_second: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.per_second, self.clock, self.sleep = max(1, int(per_second)), clock, sleep
        self.begun: deque[float] = deque()
        self.lock = threading.Lock()

    def wait(self) -> None:
        with self.lock:
            while True:
                now = self.clock()
                while self.begun and now - self.begun[0] >= 1:
                    self.begun.popleft()
                if len(self.begun) < self.per_second:
                    self.begun.append(now)
                    return
                self.sleep(1 - (now - self.begun[0]))


def with_retries(call: Callable[[], str], attempts: int, pause: float, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """The result of a call, tried at most ``attempts`` times with a pause between; None if all fail.

    An endpoint that is too busy (429, 503) is given four times the pause, then each time four times as long as before.
    """
    for k in range(attempts):
        try:
            return call()
        except (OSError, ValueError) as e:
            if k + 1 < attempts:
                sleep(pause * 4 ** (k + 1) if getattr(e, "code", None) in (429, 503) else pause)
    return None


@dataclass
class Remote(Model):
    """An endpoint asked by each task for its own rows, with a bound on calls at a time, calls a second and attempts.

    ``call(instructions, input)`` gives the answer; it must be picklable. ``tasks`` is the number of tasks that ask at a time: the limits are
    for all of them together. A prompt that fails for good has a null completion.
    """

    call: Callable[[str, str], str]
    concurrency: int = 100
    per_second: float = 600
    tasks: int = 8
    attempts: int = 3
    pause: float = 1.0

    def complete(self, prompts: DataFrame) -> DataFrame:
        threads, rate = max(1, self.concurrency // self.tasks), self.per_second / self.tasks
        call, attempts, pause = self.call, self.attempts, self.pause

        def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            limiter = RateLimiter(rate)

            def one(pair: tuple[str, str]) -> str | None:
                limiter.wait()
                return with_retries(lambda: call(*pair), attempts, pause)

            with ThreadPoolExecutor(threads) as pool:
                for frame in frames:
                    yield frame[["prompt_hash"]].assign(completion=list(pool.map(one, zip(frame["instructions"], frame["input"]))))

        keyed = prompts.withColumn("prompt_hash", prompt_hash(F.col("instructions"), F.col("input")))
        distinct = keyed.groupBy("prompt_hash").agg(F.coalesce(F.min("instructions"), F.lit("")).alias("instructions"), F.coalesce(F.min("input"), F.lit("")).alias("input"))
        answers = written(distinct.repartition(self.tasks).mapInPandas(ask, "prompt_hash string, completion string"), "answers")
        return keyed.join(answers, "prompt_hash", "left").drop("prompt_hash")


def http_chat(url: str, model: str, key_variable: str = "OPENAI_API_KEY", temperature: float = 0.0, max_tokens: int = 1024, timeout: float = 60) -> Callable[[str, str], str]:
    """A call for Remote: one chat completion over HTTP; the key is read from the environment of the worker."""

    def call(instructions: str, text: str) -> str:
        body = {"model": model, "temperature": temperature, "max_tokens": max_tokens, "messages": [{"role": "system", "content": instructions}, {"role": "user", "content": text}]}
        request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ.get(key_variable, '')}"})
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.load(answer)["choices"][0]["message"]["content"]

    return call


_LOADED: dict[str, object] = {}


def loaded(name: str, load: Callable[[], object]) -> object:
    """A model of this worker, loaded once. A worker holds one at a time: when a stage needs another, the one before is released."""
    for other in [x for x in _LOADED if x != name]:
        release(other)
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def release(name: str) -> None:
    _LOADED.pop(name, None)


@dataclass
class Local(Model):
    """A model that runs inside the workers: ``load()`` gives a function (instructions, input) -> answer, once for each worker.

    ``prepend`` is put at the end of the prompt, as the beginning of the answer.
    """

    name: str
    load: Callable[[], Callable[[str, str], str]]
    prepend: str = ""

    def complete(self, prompts: DataFrame) -> DataFrame:
        name, load, prepend = self.name, self.load, self.prepend

        def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = loaded(name, load)
            for frame in frames:
                yield frame[["prompt_hash"]].assign(completion=[model(a, b + prepend) for a, b in zip(frame["instructions"], frame["input"])])

        keyed = prompts.withColumn("prompt_hash", prompt_hash(F.col("instructions"), F.col("input")))
        distinct = keyed.groupBy("prompt_hash").agg(F.coalesce(F.min("instructions"), F.lit("")).alias("instructions"), F.coalesce(F.min("input"), F.lit("")).alias("input"))
        answers = written(distinct.mapInPandas(ask, "prompt_hash string, completion string"), "answers")
        return keyed.join(answers, "prompt_hash", "left").drop("prompt_hash")


def function_at(place: str):
    """The function that ``module:name`` names."""
    module, _, name = place.partition(":")
    return getattr(importlib.import_module(module), name)


def transformers_chat(name: str, max_new_tokens: int = 256) -> Callable[[], Callable[[str, str], str]]:
    """A loader for Local: a causal language model, by name or path, that answers greedily; needs the package transformers on the workers."""

    def load() -> Callable[[str, str], str]:
        from transformers import AutoModelForCausalLM, AutoTokenizer

        tokenizer, model = AutoTokenizer.from_pretrained(name), AutoModelForCausalLM.from_pretrained(name)

        def answer(instructions: str, text: str) -> str:
            said = [{"role": "system", "content": instructions}, {"role": "user", "content": text}]
            plain = tokenizer.apply_chat_template(said, tokenize=False, add_generation_prompt=True) if tokenizer.chat_template else f"{instructions}\n\n{text}"
            ids = tokenizer(plain, return_tensors="pt").input_ids
            out = model.generate(ids, max_new_tokens=max_new_tokens, do_sample=False)
            return tokenizer.decode(out[0][ids.shape[1] :], skip_special_tokens=True)

        return answer

    return load


def local_named(name: str) -> Local:
    """A local model by name: ``python:module:function`` calls that function (instructions, text); any other name is one of the package transformers."""
    if name.startswith("python:"):
        place = name.removeprefix("python:")
        return Local(name, lambda: function_at(place))
    if importlib.util.find_spec("transformers") is None:
        raise ValueError(f"no model {name}: the package transformers is not installed")
    return Local(name, transformers_chat(name))


# Embedders: table with a text column -> the table with ``vector``.


def hashed(dims: int = 64, prompt: str = "") -> Callable[[DataFrame, str], DataFrame]:
    """An embedder by feature hashing of words and their letter triples, of unit length; an empty text has the zero vector, null a null.

    ``prompt`` is set before each text, as asymmetric embedders want it.
    """

    def vector(text: str | None) -> list[float] | None:
        if text is None:
            return None
        v = np.zeros(dims)
        for word in (prompt + text).lower().split():
            padded = f"^{word}$"
            for gram in {word, *(padded[i : i + 3] for i in range(len(padded) - 2))}:
                h = xxhash.xxh64_intdigest(gram)
                v[h % dims] += 1.0 if (h >> 40) & 1 else -1.0
        norm = np.sqrt(v @ v)
        return (v / norm if norm else v).tolist()

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(vector)

    return lambda df, column: df.withColumn("vector", run(F.col(column)))


def looked_up(vectors: DataFrame, key: Callable[[Column], Column]) -> Callable[[DataFrame, str], DataFrame]:
    """An embedder that reads vectors (key, vector) computed before, by a key expression of the text."""
    return lambda df, column: df.withColumn("_key", key(F.col(column))).join(vectors.select(F.col("key").alias("_key"), "vector"), "_key", "left").drop("_key")


def encoding(load: Callable[[], Callable[[list[str]], object]], name: str) -> Callable[[DataFrame, str], DataFrame]:
    """An embedder that runs inside the workers: ``load()`` gives a function from a list of texts to their vectors, once for each worker; null gives null."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        kept = texts[texts.notna()]
        vectors = loaded(name, load)(kept.to_list()) if len(kept) else []
        return pd.Series([np.asarray(v, np.float32).tolist() for v in vectors], kept.index, object).reindex(texts.index).replace({np.nan: None})

    return lambda df, column: df.withColumn("vector", run(F.col(column)))


def embedder_named(spark: SparkSession, name: str, adapter: str | None = None, prompt: str = "") -> Callable[[DataFrame, str], DataFrame]:
    """The embedder that a name stands for.

    ``hash`` or ``hash:DIMS`` hashes words and letter triples; ``table:PATH`` looks texts up in a Parquet table (key, vector) by their SHA-256;
    ``python:module:function`` calls a function from a list of texts to vectors; any other name is a sentence embedder of the package
    sentence_transformers, with an ``adapter`` of its own where one is given. ``prompt`` is set before texts that are asked for.
    """
    if name.split(":")[0] == "hash":
        return hashed(int(name.split(":")[1]) if ":" in name else 64, prompt)
    if name.startswith("table:"):
        return looked_up(spark.read.parquet(name.removeprefix("table:")), lambda text: F.sha2(text, 256))
    if name.startswith("python:"):
        place = name.removeprefix("python:")
        return encoding(lambda: function_at(place), name)
    if importlib.util.find_spec("sentence_transformers") is None:
        raise ValueError(f"no embedder {name}: the package sentence_transformers is not installed")

    def load():
        from sentence_transformers import SentenceTransformer

        model = SentenceTransformer(name)
        if adapter:
            model.load_adapter(adapter)
        return lambda texts: model.encode([prompt + t for t in texts])

    return encoding(load, f"{name} {adapter or ''}")
