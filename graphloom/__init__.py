"""graphloom: a code-dependency-graph analytics engine expressed as Spark plans."""
