"""A PySpark engine that scores discussion posts for promotional intent, at table scale."""
