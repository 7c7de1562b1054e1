"""platewise: menu understanding and dish recommendation as Spark DataFrame plans."""
