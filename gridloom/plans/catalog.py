"""Importing this module registers every query."""

from gridloom.plans import q_features, q_joins, q_keyed, q_learn, q_models, q_profile, q_series, q_sinks, q_trials, q_validation  # noqa: F401
from gridloom.plans.registry import ORACLES, QUERIES  # noqa: F401
