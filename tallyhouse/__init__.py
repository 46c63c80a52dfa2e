"""Analytics over personal ledgers, as Spark DataFrame transformations."""
