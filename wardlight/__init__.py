"""Clinical cohort and risk-feature operators for PySpark."""
