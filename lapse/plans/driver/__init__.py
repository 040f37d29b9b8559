"""Queries over the star-schema tables: one per operator, most with an equivalent SQL text."""

from lapse.plans.driver import cleaning, evaluation, features, labelling, modelling, validation  # noqa: F401
from lapse.plans.driver.registry import coverage, queries, sql_texts  # noqa: F401
