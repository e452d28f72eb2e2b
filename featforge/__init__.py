"""featforge: relational feature engineering, profiling, selection and scoring as Spark jobs."""
