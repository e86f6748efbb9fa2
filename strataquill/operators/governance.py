"""Rules, policies and tools: what may be used, asked for and concluded."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluate_rules(rows: DataFrame, key: Sequence[str], rules: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """(key, rule, verdict) of every rule: NOT_APPLICABLE where its first condition does not hold, else PASS or FAIL by the second.

    A condition that is null does not hold. One pass over the rows, however many rules there are.
    """
    verdict = lambda when, holds: F.when(~F.coalesce(when, F.lit(False)), "NOT_APPLICABLE").when(F.coalesce(holds, F.lit(False)), "PASS").otherwise("FAIL")
    each = F.array(*(F.struct(F.lit(name).alias("rule"), verdict(*conditions).alias("verdict")) for name, conditions in rules.items()))
    return rows.select(*key, F.explode(each).alias("x")).select(*key, "x.*")


def source_policy(cited: DataFrame, subject: Sequence[str], grade: str, needed: Mapping[str, int]) -> DataFrame:
    """(subject, one column per grade, verdict): whether a subject has enough sources of some grade.

    ``needed`` gives grades from best to worst and how many sources of a grade or better suffice; the verdict is the best
    grade that is met, else insufficient. A source counts once per subject (``source`` names it).
    """
    once = cited.select(*subject, "source", grade).distinct()
    counted = once.groupBy(*subject).agg(*(F.count_if(F.col(grade) == g).alias(g) for g in needed))
    chain, upto = None, F.lit(0)
    for g, n in needed.items():
        upto = upto + F.col(g)
        chain = F.when(upto >= n, g) if chain is None else chain.when(upto >= n, g)
    return counted.withColumn("verdict", chain.otherwise("insufficient"))


def snapshots(admitted: DataFrame, scope: Sequence[str], record: str, rules: str) -> DataFrame:
    """(scope, items, snapshot_id): the id of what was admitted, under the version of the rules.

    It hangs on every admitted record and value and on nothing else: records are digested one by one and the digests
    summed, so no group is gathered and no order matters.
    """
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(record), F.col("value").cast("string"))), 1, 15), 16, 10).cast("decimal(38,0)")
    summed = admitted.select(*scope, record, "value").distinct().groupBy(*scope).agg(F.count("*").alias("items"), F.sum(digest).alias("__d"))
    return summed.select(*scope, "items", F.substring(F.sha2(F.concat_ws("|", F.lit(rules), *(F.coalesce(F.col(s).cast("string"), F.lit("")) for s in scope), F.col("items").cast("string"), F.col("__d").cast("string")), 256), 1, 24).alias("snapshot_id"))


def page_quality(pages: DataFrame, document: Sequence[str], text: str, low: int = 100, warn: float = 0.1, refuse: float = 0.3) -> DataFrame:
    """(document, pages, low_pages, low_share, verdict) of documents by their pages with hardly any text: ok, warn or refuse."""
    short = F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\\s", "")) < low
    counted = pages.groupBy(*document).agg(F.count("*").alias("pages"), F.count_if(short).alias("low_pages"))
    share = F.col("low_pages") / F.col("pages")
    return counted.withColumn("low_share", F.round(share, 6)).withColumn("verdict", F.when(share > refuse, "refuse").when(share >= warn, "warn").otherwise("ok"))


# Tools --------------------------------------------------------------------------------------------------------------


@dataclass
class Tool:
    """A query function under a name, the routes that may call it, and the kinds of its arguments (a name ending in ? is optional)."""

    name: str
    run: Callable[..., object]
    routes: tuple[str, ...]
    arguments: Mapping[str, type]
    retries: int = 0


@dataclass
class Toolbox:
    """A closed set of tools. Calls are checked before they run, and a tool that keeps failing is shut off for the rest of the run."""

    tools: dict[str, Tool] = field(default_factory=dict)
    failures_allowed: int = 3
    failed: dict[str, int] = field(default_factory=dict)

    def register(self, tool: Tool) -> None:
        if tool.name in self.tools:
            raise ValueError(f"{tool.name} is registered already")
        self.tools[tool.name] = tool

    def refusal(self, name: str, route: str, arguments: Mapping[str, object]) -> str | None:
        """Why a call may not run: UNKNOWN_TOOL, ROUTE_NOT_ALLOWED, CIRCUIT_OPEN or BAD_ARGUMENTS with their names; None if it may."""
        tool = self.tools.get(name)
        if tool is None:
            return "UNKNOWN_TOOL"
        if route not in tool.routes:
            return "ROUTE_NOT_ALLOWED"
        if self.failed.get(name, 0) >= self.failures_allowed:
            return "CIRCUIT_OPEN"
        kinds = {a.rstrip("?"): k for a, k in tool.arguments.items()}
        missing = [a for a in tool.arguments if not a.endswith("?") and a not in arguments]
        wrong = [a for a, v in arguments.items() if a not in kinds or not isinstance(v, kinds[a]) or (isinstance(v, bool) and kinds[a] is not bool)]
        return f"BAD_ARGUMENTS: {', '.join(sorted(missing + wrong))}" if missing or wrong else None

    def execute(self, name: str, route: str, **arguments: object) -> tuple[str, object]:
        """(OK, result), or (status, message) of a refused or failed call; a failure counts against its tool, a success clears it."""
        refused = self.refusal(name, route, arguments)
        if refused:
            return refused.split(":")[0], refused
        tool = self.tools[name]
        for attempt in range(tool.retries + 1):
            try:
                result = tool.run(**arguments)
            except Exception as problem:  # the tool's own failure is reported, not raised
                if attempt == tool.retries:
                    self.failed[name] = self.failed.get(name, 0) + 1
                    return "FAILED", str(problem)
            else:
                self.failed.pop(name, None)
                return "OK", result
        raise AssertionError("unreachable")


class Providers:
    """Named implementations of one job, such as searching or embedding, put in from outside; one of them is in use."""

    def __init__(self) -> None:
        self._known: dict[str, Callable[..., object]] = {}
        self._used: str | None = None

    def register(self, name: str, provider: Callable[..., object]) -> None:
        self._known[name] = provider
        self._used = self._used or name

    def use(self, name: str) -> None:
        if name not in self._known:
            raise KeyError(name)
        self._used = name

    def __call__(self, *arguments: object) -> object:
        if self._used is None:
            raise LookupError("no provider is registered")
        return self._known[self._used](*arguments)
