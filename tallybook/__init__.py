"""Sketches of weighted streams as Spark aggregations.

>>> spec = tallybook.ExpSketch(256)
>>> registers = tallybook.build(df, spec, keys=["day"], x="user", w="spend")
>>> tallybook.estimate(registers, spec, keys=["day"])
"""

from .operators.builtin import build_builtin, estimate_builtin, merge_builtin, set_sizes_builtin
from .operators.combine import all_pairs, clone_with, cube, dense, jaccard, merge, moving_union, rollup, set_sizes
from .operators.estimate import estimate, estimate_corrected, estimate_direct, newton
from .operators.ordered import build_ordered, last_registers, records
from .operators.registers import build, build_many, deduplicated, one_of
from .functions.memory import memory_usage
from .sources.tables import from_state, load, save, to_state
from .spec import *  # noqa: F403
from .spec import KINDS, MemoryFlag, QuantizationMode, RngEngine, SketchSpec
