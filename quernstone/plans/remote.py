"""The steps that ask a model: prompts out, answers in, through one connector."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.config import Config
from quernstone.operators import prompts, qualify, usage, verdicts
from quernstone.plans import planner
from quernstone.plans.evaluation import JUDGE_BATCH, shuffled
from quernstone.plans.scratch import written
from quernstone.sources import connector


@dataclass
class Services:
    """tiers: the models of "plan", "qualify", "escalate", "judge" and "match"; transport: see ``connector.Client``.

    With a cache equal prompts cost one call ever. calls gathers a table of calls for each step asked so far.
    """

    tiers: dict[str, connector.ModelTier]
    transport: Callable
    config: Config = Config()
    cache: usage.ResultCache | None = None
    calls: list[DataFrame] = field(default_factory=list)

    def ask(self, step: str, asked: DataFrame) -> DataFrame:
        """asked(..., prompt) with answer, written: a later step must not ask again."""
        if self.cache is None:
            out = connector.ask(asked, self.tiers[step], self.transport, self.config)
        else:
            out = connector.ask_cached(asked, self.cache, step, self.tiers[step], self.transport, self.config)
        out = written(out, f"asked-{step}")
        self.calls.append(out.where("calls > 0").select("model", "calls", "prompt_tokens", "output_tokens"))
        return out

    def usage(self, prices: DataFrame) -> DataFrame:
        """Calls, tokens and cost per model of all that was asked."""
        rows = None
        for part in self.calls:
            rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            raise ValueError("nothing was asked yet")
        return usage.costs(rows, prices).groupBy("model").agg(*[F.sum(c).alias(c) for c in ("calls", "prompt_tokens", "output_tokens", "cost")])

    def plan(self, queries: DataFrame) -> DataFrame:
        """Specs of queries(query_id, text), by the model or else by rules."""
        asked = self.ask("plan", queries.select("query_id", "text", prompts.plan_prompt(F.col("text")).alias("prompt")))
        return planner.plan_queries(queries, asked.select("query_id", "answer"))

    def verdicts(self, step: str, rows: DataFrame, specs: DataFrame, size: int) -> DataFrame:
        """query_id, org_id, verdict, confidence, reason, met, tier of rows(query_id, org_id, rank0, card, unknown)."""
        specs = prompts.complete(specs)
        asked = self.ask(step, prompts.verdict_prompts(rows, specs, size))
        members = qualify.batches(rows.select("query_id", "org_id", "rank0"), size)
        return verdicts.parse_verdicts(asked.select("query_id", "batch", "answer"), members, specs, self.tiers[step].primary)

    def grades(self, pool: DataFrame, queries: DataFrame, cards: DataFrame, size: int = JUDGE_BATCH) -> DataFrame:
        """query_id, org_id, grade, justification of pool(query_id, org_id); cards(org_id, card)."""
        rows = written(shuffled(pool).join(cards, "org_id"), "pool")
        asked = self.ask("judge", prompts.grade_prompts(rows, queries, size))
        return verdicts.parse_grades(asked.select("query_id", "batch", "answer"), qualify.batches(rows.select("query_id", "org_id", "rank0"), size))

    def matches(self, rows: DataFrame) -> DataFrame:
        """query_id, org_id, score, reason of rows(query_id, org_id, text, card), each asked on its own."""
        text: Column = prompts.match_prompt(F.col("text"), F.col("card"))
        return verdicts.parse_matches(self.ask("match", rows.select("query_id", "org_id", text.alias("prompt"))))
