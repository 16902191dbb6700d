"""lexigraph: a PySpark-native analytics engine for lexical ancestry graphs."""
