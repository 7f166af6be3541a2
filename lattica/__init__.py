"""lattica: batch integer programs (level-synchronous branch and bound) and
keyed work balancing, as PySpark DataFrame operators."""
