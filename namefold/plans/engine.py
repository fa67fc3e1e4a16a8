"""The schedule: anchors, content, structure to a fixpoint, cleanups, and a second pass with substituted names."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namefold.operators.commit import MARGIN, State, churn, commit
from namefold.operators.content import Matcher, content_matchers
from namefold.operators.project import Project
from namefold.operators.structure import structure_matchers
from namefold.operators.validators import VALIDATORS, cleanup, validate
from namefold.plans.storage import stored

#: Matchers of tier 2 that run again on substituted names.
SECOND_PASS = ("strings_plus_refs", "stable_refs_ms", "call_targets_ms", "field_targets_ms")


def default_matchers() -> list[Matcher]:
    return content_matchers() + structure_matchers()


@dataclass
class Result:
    mapping: DataFrame
    negatives: DataFrame
    matcher_stats: dict[str, dict[str, int]]
    validator_stats: dict[str, dict[str, int]]
    epochs: int
    converged: bool
    churns: list[dict] = field(default_factory=list)


class Engine:
    """Matches build ``a`` to build ``b``.

    Matchers commit one after another, each seeing what the ones before it did; with ``batch_sweeps`` the
    matchers of one tier sweep propose against one mapping and commit together, in far fewer jobs.
    """

    def __init__(self, a: Project, b: Project, matchers: Sequence[Matcher] | None = None, validators: dict | None = None, displace_margin: float = MARGIN, tier3_max_iters: int = 20, tier3_min_churn: int = 50, tier3_quiet_epochs: int = 2, two_pass: bool = True, batch_sweeps: bool = False) -> None:
        self.a, self.b = a, b
        self.matchers = list(default_matchers() if matchers is None else matchers)
        self.validators = VALIDATORS if validators is None else validators
        self.margin, self.max_iters, self.min_churn, self.quiet = displace_margin, tier3_max_iters, tier3_min_churn, tier3_quiet_epochs
        self.two_pass, self.batch = two_pass, batch_sweeps
        self.state = State.empty(a.records.sparkSession)
        self.matcher_stats: dict[str, dict[str, int]] = {}
        self.validator_stats: dict[str, dict[str, int]] = {}
        self.epochs = 0
        self.churns: list[dict] = []

    def _step(self, matchers: Sequence[Matcher], a: Project) -> int:
        """Propose and commit; returns how many pairs came, went or changed."""
        found = None
        for m in matchers:
            rows = m.candidates(a, self.b, self.state.mapping)
            found = rows if found is None else found.unionByName(rows)
        if found is None:
            return 0
        before = self.state.mapping
        self.state, fates = commit(self.state, stored(found), a, self.b, self.margin)
        for row in fates.groupBy("matcher_id", "outcome").count().collect():  # a row for each matcher and outcome
            stats = self.matcher_stats.setdefault(row["matcher_id"], {})
            for key in ("proposed", row["outcome"]):
                stats[key] = stats.get(key, 0) + row["count"]
        self.epochs += 1
        change = churn(before, self.state.mapping).first().asDict()
        self.churns.append(change | {"matchers": [m.id for m in matchers]})
        return change["added"] + change["removed"] + change["changed"]

    def _sweep(self, matchers: Sequence[Matcher], a: Project | None = None) -> int:
        a = a or self.a
        return self._step(matchers, a) if self.batch else sum(self._step([m], a) for m in matchers)

    def _validate(self) -> None:
        if self.validators:
            self.state, stats = validate(self.state, self.a, self.b, self.validators)
            for row in stats.collect():  # a row for each validator
                mine = self.validator_stats.setdefault(row["validator"], {})
                for key in ("scored", "provisional", "veto"):
                    mine[key] = mine.get(key, 0) + row[key]

    def run(self) -> Result:
        tier = {t: [m for m in self.matchers if m.tier == t] for t in (1, 2, 3)}
        for t in (1, 2):
            self._sweep(tier[t])
        self._validate()
        converged, quiet = not tier[3], 0
        for _ in range(self.max_iters if tier[3] else 0):
            changed = self._sweep(tier[3])
            self._validate()
            quiet = quiet + 1 if changed < self.min_churn else 0
            if quiet >= self.quiet:
                converged = True
                break
        self._validate()
        self.state = cleanup(self.state, self.a, self.b, reverse_saves=True)
        for _ in range(3 if tier[3] else 0):
            changed = self._sweep(tier[3])
            self._validate()
            if changed < self.min_churn:
                break
        again = [m for m in tier[2] if m.id in SECOND_PASS]
        for _ in range(2 if self.two_pass and again else 0):
            size = self.state.mapping.count()
            if not size:
                break
            renamed = self.a.substitute(self.state.mapping)
            renamed = Project(stored(renamed.records), self.a.prefix)
            self._sweep(again, renamed)
            renamed.unpersist()
            self._validate()
            if self.state.mapping.count() - size < self.min_churn:
                break
        self.state = cleanup(self.state, self.a, self.b, reverse_saves=False)
        return Result(self.state.mapping, self.state.negatives, self.matcher_stats, self.validator_stats, self.epochs, converged, self.churns)


def anchors(a: Project, b: Project) -> DataFrame:
    """The pairs that keep their name."""
    return a.classes.where(~a.obfuscated("cid")).select(F.col("cid").alias("a")).join(b.classes.select(F.col("cid").alias("a")), "a", "left_semi").withColumn("b", F.col("a"))
