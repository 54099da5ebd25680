"""Value semantics: two-valued comparisons and scalar functions on Spark columns."""
