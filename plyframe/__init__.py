"""plyframe: exhaustive analysis of finite two-player game graphs as Spark dataflows."""
