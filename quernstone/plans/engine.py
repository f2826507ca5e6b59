"""The whole plan: filter, retrieve, fuse, adjudicate, escalate, rank, for all queries of a run in one job."""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.config import Config
from quernstone.functions import text
from quernstone.operators import filters, qualify, ranking, retrieval, usage
from quernstone.plans.scratch import written

if TYPE_CHECKING:
    from quernstone.plans.remote import Services

FILTERED = ("country_code", "employee_count", "revenue", "year_founded", "is_public")


class Engine:
    """companies: the companies schema with embedding. The index of terms can be built once and passed in.

    Without one, a run counts its own terms in all documents; the whole index is built once a second set of terms is asked for.
    """

    def __init__(self, companies: DataFrame, config: Config = Config(), index: DataFrame | None = None, sizes: DataFrame | None = None) -> None:
        self.config = config
        documents = companies.withColumn("document", text.company_document()) if "document" not in companies.columns else companies
        self.companies = documents
        self._index, self._sizes, self._counted = index, sizes, None

    @property
    def index(self) -> DataFrame:
        return self._whole()[0]

    @property
    def sizes(self) -> DataFrame:
        return self._whole()[1]

    def _whole(self) -> tuple[DataFrame, DataFrame]:
        if self._index is None or self._sizes is None:
            words = written(retrieval.counted(self.companies), "words")
            self._index = self._index if self._index is not None else self.ordered(words)
            self._sizes = self._sizes if self._sizes is not None else retrieval.lengths(words)
        return self._index, self._sizes

    def lexicon(self, specs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Postings and lengths for a run: of its terms alone, if there is no index yet, else the whole index.

        Its terms hold every keyword that can occur in an index, since such a keyword is its own only token.
        """
        if self._index is None and self._sizes is None:
            named = retrieval.named_terms(retrieval.query_terms(specs))
            if self._counted is None and named is not None:
                words = written(retrieval.counted(self.companies, named=named), "words")
                self._counted = named, retrieval.postings(words), retrieval.lengths(words)
            if named is not None and named <= self._counted[0]:
                return self._counted[1:]
        return self._whole()

    @staticmethod
    def ordered(words: DataFrame) -> DataFrame:
        tokens = retrieval.lengths(words).agg(F.sum("length")).first()[0] or 0
        return written(retrieval.by_term(retrieval.postings(words), tokens), "postings")

    def survivors(self, specs: DataFrame) -> DataFrame:
        thin = self.companies.select("org_id", *FILTERED)
        return filters.survivors_relaxed(thin, specs, self.config).select("query_id", "org_id", "unknown", "complexity", (F.size("prefixes") > 0).alias("has_prefixes"))

    def fused(self, specs: DataFrame, vectors: DataFrame) -> DataFrame:
        kept = written(self.survivors(specs), "survivors")
        keys = kept.select("query_id", "org_id")
        lexical = retrieval.bm25(keys, *self.lexicon(specs), retrieval.query_terms(specs), self.config)
        near = retrieval.dense(keys, self.companies.select("org_id", "embedding"), vectors)
        codes = self.companies.select("org_id", F.explode(F.array_compact(F.concat(F.array("primary_code.code"), F.transform("secondary_codes", lambda c: c["code"])))).alias("code"))
        scored = written(retrieval.signals(kept, near, lexical, retrieval.prefix_affinity(codes, specs)), "signals")
        return retrieval.fuse(scored, self.config)

    def shortlist(self, specs: DataFrame, vectors: DataFrame) -> DataFrame:
        """At most config.max_shortlist rows a query, written: later stages read it several times."""
        return written(retrieval.shortlist(self.fused(specs, vectors), self.config), "shortlist")

    def run(self, specs: DataFrame, vectors: DataFrame, judge: Callable | None = None, second: Callable | None = None, include_rejected: bool = False, services: Services | None = None) -> DataFrame:
        """Ranked rows of every query. judge and second take the place of the built-in rules for either tier; services asks models
        for both."""
        return self.stages(specs, vectors, judge, second, include_rejected, services)["ranked"]

    def _asked(self, services: Services, step: str, rows: DataFrame, specs: DataFrame, size: int) -> DataFrame:
        cards = self.companies.withColumn("card", text.company_card()).select("org_id", "card")
        # A shortlist is bounded by the queries of a run.
        listed = F.broadcast(rows.select("query_id", "org_id", "rank0", "unknown"))
        return services.verdicts(step, cards.join(listed, "org_id"), specs, size)

    def stages(self, specs: DataFrame, vectors: DataFrame, judge: Callable | None = None, second: Callable | None = None, include_rejected: bool = False, services: Services | None = None) -> dict[str, DataFrame]:
        """What ``run`` makes of each stage: shortlist, judged (after the second opinion), ranked."""
        short = self.shortlist(specs, vectors)
        listed = qualify.keyword_hits(short, self.lexicon(specs)[0], specs)
        if services is not None:
            verdicts = self._asked(services, "qualify", listed, specs, self.config.qualify_batch).withColumn("escalated", F.lit(False))
            judged = written(ranking.with_verdicts(listed, verdicts).drop("escalated"), "judged")
        elif judge is None:
            judged = written(qualify.adjudicate_by_rules(listed, self.config).withColumn("reason", F.lit("rules")), "judged")
        else:
            verdicts = qualify.adjudicate(listed, judge, self.config.qualify_batch, "judge").withColumn("escalated", F.lit(False))
            judged = written(ranking.with_verdicts(listed, verdicts).drop("escalated"), "judged")
        if self.config.escalate:
            picked = qualify.escalation_pick(judged, self.config)
            if services is not None:
                picked = written(picked.drop("rank0").withColumnRenamed("pick", "rank0"), "picked")
            again = self._asked(services, "escalate", picked, specs, self.config.escalate_batch) if services is not None else qualify.second_opinion_by_rules(picked) if second is None else qualify.adjudicate(picked.withColumn("rank0", F.col("pick")), second, self.config.escalate_batch, "second")
            judged = qualify.escalate(judged, again)
        else:
            judged = judged.withColumn("escalated", F.lit(False))
        names = self.companies.select("org_id", text.display_name(F.col("operational_name"), F.col("website"), F.col("org_id")).alias("name"))
        named = judged.join(names, "org_id")
        return {"shortlist": short, "judged": judged, "ranked": ranking.rank(ranking.with_satisfaction(named, specs), self.config, include_rejected)}

    def funnel(self, specs: DataFrame, vectors: DataFrame, **options) -> DataFrame:
        """Per query, how many rows each stage left."""
        kept = filters.survivors_relaxed(self.companies.select("org_id", *FILTERED), specs, self.config).select("query_id", "org_id", "relaxed")
        stages = self.stages(specs, vectors, **options)
        return usage.funnel(specs, self.companies.count(), kept, stages["shortlist"], stages["judged"], stages["ranked"])
