"""Extensions: rules, detectors and score adjustments of a user's own."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from palisade.functions.binding import fresh
from palisade.model import DETECTIONS
from palisade.rules import Rule


PHASES = ("pre-detection", "detection", "post-detection", "scoring")


@dataclass(frozen=True)
class Plugin:
    """detect(value, location) -> array<detection>; adjust(detections, score) -> signed Column.

    Of a detector that says so, later detectors are skipped where it found something. Detectors
    and adjustments count only if the plugin takes part in the detection and scoring phases."""

    name: str
    rules: tuple[Rule, ...] = ()
    detect: Callable[[Column, Column], Column] | None = None
    adjust: Callable[[Column, Column], Column] | None = None
    skip_remaining: bool = False
    enabled: bool = True
    phases: tuple[str, ...] = ("detection", "scoring")

    def __post_init__(self):
        if unknown := set(self.phases) - set(PHASES):
            raise ValueError(f"unknown phases: {sorted(unknown)}")


@dataclass
class Registry:
    """Plugins in the order in which they were registered."""

    plugins: dict[str, Plugin] = field(default_factory=dict)

    def register(self, plugin: Plugin) -> None:
        if plugin.name in self.plugins:
            raise ValueError(f"plugin {plugin.name} is registered already")
        self.plugins[plugin.name] = plugin

    def unregister(self, name: str) -> bool:
        return self.plugins.pop(name, None) is not None

    def active(self) -> list[Plugin]:
        return [p for p in self.plugins.values() if p.enabled]

    def in_phase(self, phase: str) -> list[Plugin]:
        return [p for p in self.active() if phase in p.phases]

    def rules(self) -> tuple[Rule, ...]:
        return tuple(rule for p in self.active() for rule in p.rules)

    def detections(self, value: Column, location: Column) -> Column:
        none = F.expr(f"cast(array() as {DETECTIONS})")
        found, stopped = none, F.lit(False)
        for plugin in self.in_phase("detection"):
            if plugin.detect is None:
                continue
            own = F.when(stopped, none).otherwise(F.coalesce(plugin.detect(value, location), none))
            found = F.concat(found, own)
            if plugin.skip_remaining:
                stopped = stopped | (F.size(own) > 0)
        return found

    def adjustment(self, detections: Column, score: Column) -> Column:
        """The sum of all adjustments; applying it to a score is up to the caller."""
        return sum((p.adjust(detections, score) for p in self.in_phase("scoring") if p.adjust), F.lit(0))


@dataclass
class Found:
    """What a Python detector yields: a detection (as a dict of its fields) or none, an adjustment of the
    score, tags and metadata of its own."""

    detection: dict | None = None
    adjustment: int = 0
    tags: tuple[str, ...] = ()
    metadata: dict[str, str] = field(default_factory=dict)


FOUND = f"detections {DETECTIONS}, adjustment int, tags array<string>, metadata map<string,string>"


def table_function(make: Callable[[], Callable[[str, str], Iterable[Found]]]):
    """A table function, over Arrow, of a detector in Python: make() gives detect(value, location), once a task.

    It takes a row's values and gives one row (FOUND): a lateral join keeps it beside its own, without a shuffle."""

    class Detector:
        def __init__(self):
            self.detect = make()

        def eval(self, values):
            detections, adjustment, tags, metadata = [], 0, set(), {}
            for each in values or ():
                if each["value"] is None:
                    continue
                for found in self.detect(each["value"], each["location"]):
                    if found.detection:
                        detections.append({"tags": [], **found.detection, "location": each["location"]})
                    adjustment += found.adjustment
                    tags.update(found.tags)
                    metadata.update(found.metadata)
            yield detections, adjustment, sorted(tags), metadata

    return udtf(Detector, returnType=FOUND, useArrow=True)


def detected(rows: DataFrame, values: dict[str, Column], *detectors, skip_remaining: bool = False) -> DataFrame:
    """rows with plugin_detections, plugin_adjustment (the sum), plugin_tags (different ones, sorted) and
    plugin_metadata (of equal keys the last detector's) of what table functions find in values, by location.

    With skip_remaining a row that a detector found something in is not shown to those after it."""
    given, *own = fresh(rows, "__given", *(f"__found{k}" for k in range(len(detectors))))
    pairs = [F.struct(F.lit(location).alias("location"), value.cast("string").alias("value")) for location, value in values.items()]
    out, names = rows.withColumn(given, F.array(*pairs)), []
    for detector, name in zip(detectors, own):
        before = [F.size(F.col(n)["detections"]) > 0 for n in names] if skip_remaining else []
        shown = F.when(~reduce(Column.__or__, before, F.lit(False)), F.col(given))
        (sent,) = fresh(out, "__sent")
        out = out.withColumn(sent, shown)
        # Packed before the join, so that it meets no column of the same name.
        found = detector(F.col(sent).outer()).select(F.struct("detections", "adjustment", "tags", "metadata").alias(name))
        out = out.lateralJoin(found).drop(sent)
        names.append(name)
    each = lambda part: [F.col(n)[part] for n in names]
    none = F.expr(f"cast(array() as {DETECTIONS})")
    return out.select(
        *[F.col(f"`{c}`") for c in rows.columns],
        F.concat(none, *each("detections")).alias("plugin_detections"),
        sum(each("adjustment"), F.lit(0)).alias("plugin_adjustment"),
        F.array_sort(F.array_distinct(F.concat(F.expr("cast(array() as array<string>)"), *each("tags")))).alias("plugin_tags"),
        reduce(lambda a, b: F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b), each("metadata"), F.expr("cast(map() as map<string,string>)")).alias("plugin_metadata"),
    )
