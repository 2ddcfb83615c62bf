"""The temporal table: a DataFrame plus a small frozen description of its index and key."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.calendar import Axis, Interval, Period
from .operators.layout import Layout


@dataclass(frozen=True)
class Nested:
    """A key column that lives inside another: ``nested("service", "category")``."""

    child: str
    parent: str


def nested(child: str, parent: str, *outer: str) -> Nested | tuple[Nested, ...]:
    """From the innermost column outwards: ``nested("city", "state", "country")`` is a key of three levels."""
    path = (child, parent, *outer)
    chain = tuple(Nested(c, p) for c, p in zip(path, path[1:]))
    return chain if outer else chain[0]


@dataclass(frozen=True)
class Meta:
    """What is declared about a temporal table. Nothing here is inferred from the rows.

    ``dense`` means every series has a row at each interval of its own span; ``shared_span`` that all
    series cover the same span. ``max_rows`` is a bound on the rows of one series, when known.
    ``costly`` marks a table whose plan already holds a two-pass operation. ``lattice`` says that all
    distances in a series are known to be multiples of the interval. An interval of 0 units is one whose
    count is still to be found: ``require_interval`` does (a job). ``ties`` order the observations of one instant,
    as long as the table has these columns.
    """

    index: str
    key: tuple[str, ...] = ()
    nesting: tuple[Nested, ...] = ()
    interval: Interval | None = None
    groups: tuple[str, ...] = ()
    index_by: tuple[str, Period] | None = None
    dense: bool = False
    shared_span: bool = False
    max_rows: int | None = None
    costly: bool = False
    lattice: bool = False
    layout: Layout = field(default_factory=Layout)
    ties: tuple[str, ...] = ()

    @property
    def regular(self) -> bool:
        return self.interval is not None

    @property
    def key_label(self) -> str:
        inside = {n.child: n.parent for n in self.nesting}
        parents = set(inside.values())

        def path(column: str) -> list[str]:
            return [column, *path(inside[column])] if column in inside else [column]

        return ", ".join(" | ".join(path(k)) for k in self.key if k not in parents)

    @property
    def group_label(self) -> str:
        label = ", ".join(self.groups)
        return f"{label} @ {self.index_by[0]}".strip() if self.index_by else label


def split_key(key: list[str | Nested | tuple[Nested, ...]]) -> tuple[tuple[str, ...], tuple[Nested, ...]]:
    columns: list[str] = []
    nesting: list[Nested] = []
    for k in key:
        if isinstance(k, str):
            columns.append(k)
            continue
        links = (k,) if isinstance(k, Nested) else k
        nesting += links
        columns += [c for n in links for c in (n.child, n.parent)]
    inside = {n.child: n.parent for n in nesting}
    for start in inside:
        at, steps = start, 0
        while at in inside and steps <= len(inside):
            at, steps = inside[at], steps + 1
        if at in inside:
            raise ValueError(f"{start} is nested in itself")
    return tuple(dict.fromkeys(columns)), tuple(nesting)


class TemporalFrame:
    """Verbs over (DataFrame, Meta). Every verb is lazy and returns a new frame unless it says so."""

    def __init__(self, df: DataFrame, meta: Meta):
        missing = [c for c in (meta.index, *meta.key) if c not in df.columns]
        if missing:
            raise ValueError(f"index or key column not in the table: {', '.join(missing)}")
        self.df = df
        self.meta = meta

    # -- description -------------------------------------------------------------------------
    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def axis(self) -> Axis:
        zone = self.df.sparkSession.conf.get("spark.sql.session.timeZone")
        return Axis.of(self.df.schema[self.meta.index].dataType, self.meta.interval, zone)

    @property
    def ties(self) -> tuple[str, ...]:
        """The columns that order observations of one instant; none after a verb that leaves one per instant."""
        return tuple(c for c in self.meta.ties if c in self.df.columns)

    @property
    def measures(self) -> list[str]:
        """Columns that are neither index, key nor index group."""
        m = self.meta
        fixed = {m.index, *m.key, *([m.index_by[0]] if m.index_by else [])}
        return [c for c in self.df.columns if c not in fixed]

    def with_(self, df: DataFrame | None = None, **changes: object) -> "TemporalFrame":
        return TemporalFrame(self.df if df is None else df, replace(self.meta, **changes))

    def require_interval(self) -> Interval:
        found = self.meta.interval
        if found is not None and found.n == 0:
            from .operators.declare import detect_interval

            # Where no series has two rows, any count of units is right.
            found = detect_interval(self) or replace(found, n=1)
        if found is None:
            raise ValueError("the index is irregular: declare an interval first")
        return found

    def resolved(self) -> "TemporalFrame":
        """The same table with its interval found, if that was open (a job)."""
        if self.meta.interval is None or self.meta.interval.n:
            return self
        return self.with_(interval=self.require_interval(), lattice=True)

    def describe(self) -> DataFrame:
        from .operators.declare import describe

        return describe(self)

    def preview(self, n: int = 6) -> DataFrame:
        """The first rows from past to future, series by series (a top-k, not a full sort)."""
        return self.arrange().df.limit(n)

    # -- projection --------------------------------------------------------------------------
    def mutate(self, **columns: object) -> "TemporalFrame":
        """Add or replace columns one after another; a later one sees the earlier ones.

        A value is a column expression or a window call such as ``slide_dbl("x", "mean", size=7)``.
        Neighbouring window calls of one kind share a shuffle.
        """
        from .operators.windows import WindowCall, apply_windows

        protected = {self.meta.index, *self.meta.key} & set(columns)
        if protected:
            raise ValueError(f"mutate cannot replace index or key columns: {', '.join(sorted(protected))}")
        tf, pending = self, {}

        def reads_pending(call: WindowCall) -> bool:
            return bool(set(call.columns) & set(pending))

        for name, value in columns.items():
            if isinstance(value, WindowCall):
                kinds = {c.kind for c in pending.values()}
                if pending and (kinds != {value.kind} or reads_pending(value) or name in pending):
                    tf, pending = apply_windows(tf, pending), {}
                pending[name] = value
                continue
            if pending:
                tf, pending = apply_windows(tf, pending), {}
            expr = value if isinstance(value, Column) else F.lit(value)
            tf = tf.with_(tf.df.withColumn(name, expr))
        return apply_windows(tf, pending) if pending else tf

    def transmute(self, **columns: object) -> "TemporalFrame":
        """Like ``mutate`` but keeps only index, key and the named columns."""
        return self.mutate(**columns).select(*columns)

    def select(self, *columns: str) -> "TemporalFrame":
        """Keep columns; the key, the index, the ties and the groups stay whether named or not."""
        m = self.meta
        fixed = [m.index, *m.key, *self.ties, *m.groups, *([m.index_by[0]] if m.index_by else [])]
        kept = list(columns) + [c for c in dict.fromkeys(fixed) if c not in columns]
        return self.with_(self.df.select(*kept))

    def rename(self, **new_from_old: str) -> "TemporalFrame":
        """``rename(new="old")``; the description follows when the index or a key is renamed."""
        to = {old: new for new, old in new_from_old.items()}
        missing = [old for old in to if old not in self.df.columns]
        if missing:
            raise ValueError(f"no column to rename: {', '.join(missing)}")
        m = self.meta
        name = lambda c: to.get(c, c)
        period = m.index_by and (name(m.index_by[0]), replace(m.index_by[1], source=name(m.index_by[1].source)))
        return self.with_(
            self.df.withColumnsRenamed(to),
            index=name(m.index),
            key=tuple(map(name, m.key)),
            nesting=tuple(Nested(name(n.child), name(n.parent)) for n in m.nesting),
            groups=tuple(map(name, m.groups)),
            index_by=period,
            ties=tuple(map(name, m.ties)),
        )

    def pull(self, column: str) -> DataFrame:
        """One column as a distributed table, to feed a semi join or a lookup."""
        return self.df.select(column)

    # -- rows --------------------------------------------------------------------------------
    def filter(self, *conditions: Column) -> "TemporalFrame":
        df = self.df
        for c in conditions:
            df = df.where(c)
        return self.with_(df, dense=False, shared_span=False)

    def arrange(self, *order: str | Column) -> "TemporalFrame":
        """Sort, nulls last; by key and index when no order is given."""
        from .operators.relational import sort_columns

        return self.with_(self.df.orderBy(*sort_columns(order or (*self.meta.key, self.meta.index))))

    def slice(self, first: int, last: int) -> "TemporalFrame":
        """Rows at 1-based positions ``first..last`` of each group, or of the whole sorted table."""
        from .operators.relational import slice_rows

        return slice_rows(self, first, last)

    def row_number(self, name: str = "row") -> "TemporalFrame":
        """Add the 1-based position of each row in its series."""
        from .operators.layout import P, positions

        placed = positions(self)
        df = placed.df.select(*self.df.columns, (F.col(P) + 1).alias(name))
        return self.with_(df, costly=placed.blocked)

    # -- groups and summaries ----------------------------------------------------------------
    def group_by(self, *columns: str) -> "TemporalFrame":
        missing = [c for c in columns if c not in self.df.columns]
        if missing:
            raise ValueError(f"no column to group by: {', '.join(missing)}")
        return self.with_(groups=tuple(columns))

    def ungroup(self) -> "TemporalFrame":
        return self.with_(groups=(), index_by=None)

    def index_by(self, **period: Period) -> "TemporalFrame":
        """Add a calendar period of the index and make it the index group of the next summary."""
        if len(period) != 1:
            raise ValueError("index_by takes exactly one named period")
        (name, p), = period.items()
        if p.source != self.meta.index:
            raise ValueError(f"index_by needs a period of the index {self.meta.index!r}, not {p.source!r}")
        return self.with_(self.df.withColumn(name, p.column()), index_by=(name, p))

    def summarise(self, **aggregates: Column) -> "TemporalFrame":
        from .operators.summarise import summarise

        return summarise(self, **aggregates)

    summarize = summarise

    def share(self, value: str, within: list[str], name: str = "share") -> "TemporalFrame":
        from .operators.summarise import share

        return self.with_(share(self.df, value, [*within, self.meta.index], name))

    # -- gaps --------------------------------------------------------------------------------
    def fill_na(self, full: bool = False, max_ratio: float | None = None, **values: object) -> "TemporalFrame":
        from .operators.gaps import fill_na

        return fill_na(self, full, max_ratio, **values)

    def count_gaps(self, full: bool = False) -> DataFrame:
        from .operators.gaps import count_gaps

        return count_gaps(self, full)

    # -- windows that change the number of rows -----------------------------------------------
    def tiles(self, **calls: object) -> "TemporalFrame":
        from .operators.windows import tiles

        return tiles(self, **calls)

    def slide_period(self, period: Period, name: str = "period", size: int = 2, partial: bool = False, **calls: object):
        from .operators.windows import slide_period

        return slide_period(self, period, name, size, partial, **calls)

    # -- joins and reshapes --------------------------------------------------------------------
    def join(self, other: "TemporalFrame | DataFrame", on: list[str], how: str = "inner", **options: object):
        from .operators.relational import temporal_join

        return temporal_join(self, other, on, how, **options)

    def inner_join(self, other, on, **options):
        return self.join(other, on, "inner", **options)

    def left_join(self, other, on, **options):
        return self.join(other, on, "left", **options)

    def right_join(self, other, on, **options):
        return self.join(other, on, "right", **options)

    def full_join(self, other, on, **options):
        return self.join(other, on, "full", **options)

    def semi_join(self, other, on, **options):
        return self.join(other, on, "semi", **options)

    def anti_join(self, other, on, **options):
        return self.join(other, on, "anti", **options)

    def gather(self, columns: list[str], names_to: str = "name", values_to: str = "value") -> "TemporalFrame":
        """Wide to long: the former column name becomes part of the key."""
        from .operators.reshape import gather

        df = gather(self.df, columns, names_to, values_to)
        return self.with_(df, key=(*self.meta.key, names_to))

    def spread(self, column: str, value: str, levels: list[object] | None = None, fill: object = None) -> "TemporalFrame":
        """Long to wide: the spread column leaves the key. Other measures have no place in the result and
        are refused: drop or spread them by themselves."""
        from .operators.reshape import spread

        m = self.meta
        others = [c for c in self.measures if c not in (column, value)]
        if others:
            raise ValueError(f"spread would lose {', '.join(others)}: select {value} first")
        ids = [m.index, *[k for k in m.key if k != column]]
        df = spread(self.df, ids, column, value, levels, fill)
        return self.with_(
            df,
            key=tuple(k for k in m.key if k != column),
            nesting=tuple(n for n in m.nesting if column not in (n.child, n.parent)),
            groups=tuple(g for g in m.groups if g != column),
            dense=m.dense and m.shared_span,
            max_rows=m.max_rows if column not in m.key else None,
        )

    def nest(self, by: list[str], name: str = "data", part_rows: int | None = None) -> DataFrame:
        from .operators.reshape import nest

        return nest(self, by, name, part_rows)

    # -- storage -------------------------------------------------------------------------------
    def materialize(self) -> "TemporalFrame":
        """Run the plan once and write the table to the shared folder (a job).

        Use it on a small summary that several windows read, or before a second pass over an expensive
        plan. Later passes read only the columns they need. The folder is the one the cluster names in
        ``spark.checkpoint.dir``, so the work survives the loss of executors.
        """
        from .sources.storage import staged

        return self.with_(staged(self.df), costly=False)
