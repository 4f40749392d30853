"""tablemend: repair of contradicting multi-source tables, as Spark DataFrame jobs."""

from tablemend.spec import CostModel, EditRule, RepairSpec

__all__ = ["CostModel", "EditRule", "RepairSpec"]
