"""Every core query and the SQL it is checked against."""

from textloom.plans import articles, annotation, corpus, evaluation, further, review, smaller, streams, structure, texts, web  # noqa: F401
from textloom.plans.registry import ORACLE, QUERIES  # noqa: F401
