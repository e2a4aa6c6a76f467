"""Pattern-action programs: parsed on the driver, lowered to one Spark plan where their state allows it."""

from .run import Program, run

__all__ = ["Program", "run"]
