"""Multi-tenant daily sales analytics on Spark.

Every public function takes and returns DataFrames; nothing is evaluated until the caller runs an
action. A tenant is the pair ``(restaurant_id, location_id)`` and is always a grouping key, never a
loop variable.
"""
