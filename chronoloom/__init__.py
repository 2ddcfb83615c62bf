"""Temporal tables on Spark: an index, a key, and the verbs that respect both."""

import sys

from pyspark import cloudpickle

from .frame import Meta, Nested, TemporalFrame, nested
from .functions.aggregates import highest, lowest, mean, n_distinct, n_rows, total
from .functions.bodies import Accumulator, Part, aggregate, fold, on_list, opaque
from .functions.calendar import (
    Interval,
    Period,
    day,
    year,
    yearmonth,
    yearmonth_label,
    yearquarter,
    yearweek,
)
from .functions.scalar import constant, cut_at_blank, if_else, is_in, parse_dmy, paste, recode, regex_replace
from .operators.declare import as_temporal, broken_nesting, describe, detect_interval, duplicates, interval_of, off_lattice
from .operators.gaps import fill_size
from .operators.layout import Layout
from .operators.levels import LevelOrder, lump_drop, lump_keep, present_levels
from .operators.relational import bind_rows, desc, join, top_k
from .operators.reshape import branches, gather, hierarchy, hierarchy_of, nest, spread, spread_pages, unnest
from .operators.summarise import share
from .operators.windows import FAMILY, WindowCall, slider, stretcher, tiler
from .sources.series import StoredSeries, read_series, write_series
from .sources.storage import lower_names, read_csv_files, read_table, scratch_path, write_table

# slide, slide_dbl, slide2, pslide_chr, tile, ptile_int, stretch2_lgl, ...: the whole window family.
globals().update(FAMILY)

# Send the few Python functions that run in tasks by value: executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [n for n in globals() if not n.startswith("_")]
