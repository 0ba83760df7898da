"""topolake: a PySpark-native analytics engine for software-topology data."""
