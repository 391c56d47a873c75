"""The query language: text -> syntax tree -> DataFrame plan (typed lane) or document evaluator (dynamic lane)."""
