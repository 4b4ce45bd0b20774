"""All registered queries."""

import importlib

from tidecast.plans.registry import ORACLES, QUERIES  # noqa: F401

for _m in ["q_sources", "q_facts", "q_profile", "q_ledger", "q_forecast", "q_learn", "q_text", "q_streaming", "q_models", "q_daily"]:
    importlib.import_module(f"tidecast.plans.{_m}")
