"""Every registered query of the library and its DuckDB SQL."""

from . import dataset_plans, event_plans, wave_plans

PLANS = event_plans.PLANS | wave_plans.PLANS | dataset_plans.PLANS
QUERIES = {name: query for name, (query, _) in PLANS.items()}
ORACLES = {name: sql for name, (_, sql) in PLANS.items() if sql}
