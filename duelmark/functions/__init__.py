"""Column functions: every public name takes and returns Spark columns."""

from duelmark.functions.names import (  # noqa: F401
    alias_of, clean_text, entity_key, id_from_url, norm_name, pair_key, unresolved_key,
)
from duelmark.functions.parsing import (  # noqa: F401
    clock_seconds, division_limit, duration_minutes, height_inches, leading_number,
    method_class, outcome_side, parse_date, split_sides, x_of_y,
)
from duelmark.functions.pricing import (  # noqa: F401
    ceil_american, clipped_logit, devig, fair_american, implied_prob, market_probability,
    overround, signed_price, unit_profit, valid_price,
)
from duelmark.functions.timing import (  # noqa: F401
    age_years, hours_between, lead_hours, quote_age_minutes, scheduled_start, start_precision,
)
from duelmark.functions.ids import event_seed, hash_id, uniform_index  # noqa: F401
