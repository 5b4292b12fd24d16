"""tessel: a columnar analytics engine expressed entirely as Spark logical plans.

Every operator maps ``DataFrame -> DataFrame`` lazily; Catalyst and Tungsten choose the physical plan.
"""

from tessel.frame import Frame
from tessel.plans.expr import call, col, lit, slot

__all__ = ["Frame", "call", "col", "lit", "slot"]
