"""The optional refinement by an outside model: what it is asked, and what its answer means.

The model itself is a callable ``(labels, groups) -> text``. Answers are JSON,
``{"groups": [{"canonical": ..., "originals": [...]}], "ranking": [...]}``, with or without
code fences. Any failure leaves both lookups empty.
"""

from __future__ import annotations

import json
import queue
import threading
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.functions.fixed import CHARS_PER_TOKEN, MODEL_SECONDS, MODEL_TOKENS, PROMPT_BASE, PROMPT_TOKENS, REFINE_MEMO, TOKENS_PER_ITEM
from marlstone.session import ship

ANSWER = "struct<groups:array<struct<canonical:string,originals:array<string>>>,ranking:array<string>>"
Model = Callable[[list[str], list[str]], str]


def labels(annotated: DataFrame) -> DataFrame:
    """``(label, series_key, ord)``: names of series with the key that they had first."""
    rows = annotated.where(F.col("series_key").isNotNull() & (F.coalesce("parsed.series", F.lit("")) != ""))
    return rows.groupBy(F.col("parsed.series").alias("label")).agg(F.min_by("series_key", "ord").alias("series_key"), F.min("ord").alias("ord"))


def groups(annotated: DataFrame) -> DataFrame:
    """``(name, ord)``: distinct names of release groups, by first place."""
    return annotated.select(X.empty_as_null(F.col("parsed.group")).alias("name"), "ord").dropna(subset=["name"]).groupBy("name").agg(F.min("ord").alias("ord"))


def cost(text) -> F.Column:
    return (F.ceil(X.utf16_length(text) / CHARS_PER_TOKEN) + TOKENS_PER_ITEM).cast("long")


def _cost(text: str) -> int:
    return -(-(len(text.encode("utf-16-le")) // 2) // CHARS_PER_TOKEN) + TOKENS_PER_ITEM


def estimate(names: Iterable[str], crews: Iterable[str]) -> int:
    return PROMPT_BASE + sum(map(_cost, names)) + sum(map(_cost, crews))


def chunks(names: list[str], crews: list[str], budget: int = PROMPT_TOKENS) -> list[tuple[list[str], list[str]]]:
    """Prompts within the budget: labels in order, the groups in each of them."""
    if estimate(names, crews) <= budget:
        return [(names, crews)]
    left, out = budget - estimate([], crews), []
    for number, name in _numbered(((n, _cost(n)) for n in names), left):
        if number == len(out):
            out.append(([], crews))
        out[number][0].append(name)
    return out


def _numbered(items: Iterable[tuple], budget: int) -> Iterator[tuple]:
    """(chunk, item): a chunk ends before the item that would take it over the budget."""
    chunk, used, empty = 0, PROMPT_BASE, True
    for item, n in items:
        if used + n > budget and not empty:
            chunk, used = chunk + 1, PROMPT_BASE
        used, empty = used + n, False
        yield chunk, item


def chunked(names: DataFrame, budget: int) -> DataFrame:
    """``(ord, label)`` with ``chunk``, for a label budget; the sum starts anew with each chunk.

    Each chunk's start hangs on the one before, so the rows stream through one task in order,
    which keeps two numbers.
    """

    def run(batches):
        import pandas as pd

        state = [0, PROMPT_BASE, True]
        for b in batches:
            at = []
            for n in b["cost"]:
                if state[1] + n > budget and not state[2]:
                    state[0], state[1] = state[0] + 1, PROMPT_BASE
                state[1], state[2] = state[1] + int(n), False
                at.append(state[0])
            yield pd.DataFrame({"ord": b["ord"], "label": b["label"], "cost": b["cost"], "chunk": at})

    ship(names.sparkSession)
    rows = names.select(F.col("ord").cast("long"), "label", cost(F.col("label")).alias("cost"))
    return rows.coalesce(1).sortWithinPartitions("ord").mapInPandas(run, "ord long, label string, cost long, chunk long")


def parsed_answer(text) -> F.Column:
    """A model's text as ``ANSWER``; null parts where it is no such JSON."""
    bare = F.regexp_replace(F.regexp_replace(X.trim(text), r"(?i)^```(?:json)?\s*", ""), r"```\s*\z", "")
    return F.from_json(X.trim(bare), ANSWER)


def cluster_remap(answers: DataFrame, known: DataFrame) -> DataFrame:
    """``(key, canonical)`` from rows (``pos``, ``answer``) and the labels (``label``, ``series_key``).

    Labels that were not asked for are left out, and clusters of fewer than two with them; of
    several places for a key the last holds.
    """
    clusters = answers.select("pos", F.posexplode("answer.groups").alias("c", "g")).select("pos", "c", F.col("g.canonical").alias("canonical"), F.posexplode("g.originals").alias("k", "label"))
    kept = clusters.join(known.select("label", "series_key"), "label")
    sizes = kept.groupBy("pos", "c").agg(F.count("*").alias("n"), F.min_by("label", "k").alias("head")).where("n >= 2")
    rows = kept.join(sizes, ["pos", "c"]).withColumn("to", X.series_key(F.coalesce(X.empty_as_null(F.col("canonical")), F.col("head")))).where("series_key <> to")
    return rows.groupBy(F.col("series_key").alias("key")).agg(F.max_by("to", F.struct("pos", "c", "k")).alias("canonical"))


def ranking_scores(answers: DataFrame, asked: DataFrame) -> DataFrame:
    """``(name, score)``: the first known group has the list's length, each known one after it one less."""
    from pyspark.sql import Window

    names = answers.select("pos", F.size("answer.ranking").alias("n"), F.posexplode("answer.ranking").alias("k", "g")).withColumn("name", F.lower("g"))
    known = names.join(asked.select(F.lower("name").alias("name")).distinct(), "name", "left_semi")
    place = F.row_number().over(Window.partitionBy("pos").orderBy("k"))  # an answer has at most a few hundred names
    scores = known.withColumn("score", (F.col("n") - place + 1).cast("long"))
    return scores.groupBy("name").agg(F.max_by("score", F.struct("pos", "k")).alias("score"))


def memo_key(names: Iterable[str], crews: Iterable[str]) -> str:
    return "\u0002".join("\u0001".join(sorted(x.lower() for x in xs)) for xs in (names, crews))


def prompt(names: list[str], crews: list[str]) -> str:
    """What a text model is asked for one chunk: clusters of series names and an order of groups, as JSON."""
    listed = lambda xs: "\n".join(f"{k}. {x}" for k, x in enumerate(xs, 1)) or "(none)"
    return (
        "Two lists follow. Put series names that mean the same work into one cluster, whatever script or season "
        "they are written in, and give each cluster a canonical name. Then order the groups from the best known "
        "for quality to the least.\n"
        f"\nSeries:\n{listed(names)}\n\nGroups:\n{listed(crews)}\n\n"
        'Answer with JSON alone: {"groups": [{"canonical": text, "originals": [text]}], "ranking": [text]}. '
        "Use the names as they stand in the lists, and leave out clusters of one name."
    )


def text_model(call: Callable[..., str], most: int = MODEL_TOKENS) -> Model:
    """A model for ``Refiner`` from a function of ``(prompt, max_tokens=...)``."""
    return lambda names, crews: call(prompt(names, crews), max_tokens=most)


class Refiner:
    """Calls a model once for each chunk, within ``seconds`` and without a second try, and remembers the last answers."""

    def __init__(self, model: Model | None = None, budget: int = PROMPT_TOKENS, memo: int = REFINE_MEMO, seconds: float = MODEL_SECONDS):
        self.model, self.budget, self.size, self.seconds = model, budget, memo, seconds
        self.memo: OrderedDict[str, list[str]] = OrderedDict()

    def ask(self, names: list[str], crews: list[str]) -> list[str]:
        """Texts of the answers; none without a model, with nothing to compare, or after a failure."""
        if self.model is None or (len(names) < 2 and len(crews) < 2):
            return []
        key = memo_key(names, crews)
        if key in self.memo:
            self.memo.move_to_end(key)
            return self.memo[key]
        try:
            found = [self._called(a, b) for a, b in chunks(names, crews, self.budget)]
            for text in found:
                json.loads(_bare(text))
        except Exception:  # the refinement is optional: whatever fails in the model leaves the rules' result
            return []
        self._remember(key, found)
        return found

    def ask_together(self, requests: list[tuple[list[str], list[str]]]) -> list[list[str]]:
        """Answers to requests (names, groups) of one window: the union is asked for once, every caller gets that answer, and it is remembered for each request by itself."""
        held = [self.memo.get(memo_key(*r)) for r in requests]
        open_ = [r for r, h in zip(requests, held, strict=True) if h is None and (len(r[0]) >= 2 or len(r[1]) >= 2)]
        names, crews = (list(dict.fromkeys(x for r in open_ for x in r[k])) for k in (0, 1))
        found = self.ask(names, crews) if open_ else []
        for r in open_ if found else []:
            self._remember(memo_key(*r), found)
        return [h if h is not None else found if r in open_ else [] for r, h in zip(requests, held, strict=True)]

    def _remember(self, key: str, found: list[str]) -> None:
        self.memo[key] = found
        self.memo.move_to_end(key)
        while len(self.memo) > self.size:
            self.memo.popitem(last=False)

    def _called(self, names: list[str], crews: list[str]) -> str:
        """One call; one that takes too long counts as failed, and is left to itself."""
        done: queue.Queue = queue.Queue()

        def run() -> None:
            try:
                done.put((self.model(names, crews), None))
            except Exception as e:
                done.put((None, e))

        threading.Thread(target=run, daemon=True).start()
        text, why = done.get(timeout=self.seconds)
        if why is not None:
            raise why
        return text

    def lookups(self, annotated: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``(key, canonical)`` and ``(name, score)`` for a search's items, which are at most a few hundred."""
        spark, known, crews = annotated.sparkSession, labels(annotated), groups(annotated)
        texts = self.ask([r[0] for r in known.orderBy("ord").select("label").collect()], [r[0] for r in crews.orderBy("ord").select("name").collect()]) if self.model else []
        rows = spark.createDataFrame(list(enumerate(texts)), "pos int, text string").select("pos", parsed_answer(F.col("text")).alias("answer"))
        return cluster_remap(rows, known), ranking_scores(rows, crews)


def _bare(text: str) -> str:
    text = text.strip()
    if text.startswith("```"):
        text = text[3:].removeprefix("json")
    return text.removesuffix("```").strip()
