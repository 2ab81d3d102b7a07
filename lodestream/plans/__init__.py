"""Registered queries: each module holds QUERIES, name -> (spark, sf_dir) -> DataFrame, and ORACLES, name -> DuckDB SQL."""
