from .classify import SERVICE_GROUPS, service_group
from .dates import as_date, month_end, month_start, months_back, validate_days
from .ids import monthly_record_id, record_id, stable_id
from .money import (
    exact_sum, format_money, money, pct_change, per_day, pct_of_limit, parse_amount, severity_for_pct, usd_text,
)
from .text import fenced_json, normalise_region, sorted_json
