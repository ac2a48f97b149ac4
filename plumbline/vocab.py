"""Vocabularies, thresholds and patterns.

Everything in this file is a fixed value: results are only comparable when these are the same
everywhere, so they are written out plainly and in their natural order.
"""

# ---- fixed values: generic types, semantic vocabulary -------------------------------------------
NUMERIC_GENERIC = ("integer", "decimal", "float")
DATE_GENERIC = ("date", "datetime")

SEMANTIC_TYPES = (
    "identifier", "business_key", "foreign_key", "parent_key",
    "label", "person_name", "organization_name", "description", "free_text",
    "email", "phone", "address", "postal_code", "country_code", "url",
    "birth_date", "event_date", "event_timestamp",
    "amount", "price", "cost", "quantity", "percentage", "rate", "count",
    "currency_code", "status_code", "category_code", "hierarchy_level", "flag", "other",
)
KEY_TYPES = ("identifier", "business_key", "foreign_key", "parent_key")
TEXT_TYPES = ("label", "person_name", "organization_name", "description", "free_text")
DATE_TYPES = ("birth_date", "event_date", "event_timestamp")
NUMERIC_TYPES = ("amount", "price", "cost", "quantity", "percentage", "rate", "count")
CODE_TYPES = ("status_code", "category_code", "hierarchy_level", "currency_code", "country_code")
PII_TYPES = ("person_name", "email", "phone", "address", "birth_date", "postal_code")

CATEGORIES = ("data_quality", "hierarchy", "business")
DIMENSIONS = ("completeness", "validity", "uniqueness", "consistency", "referential_integrity", "accuracy", "timeliness")
SCOPES = ("column", "row", "table", "cross_table")
SEVERITIES = ("critical", "high", "medium", "low")
ORIGINS = ("llm", "steward", "heuristic")
STATUSES = ("proposed", "approved", "rejected")
DECISIONS = ("approved", "rejected", "modified")
OPERATORS = ("=", "<>", "<", "<=", ">", ">=")
REASON_CODES = ("wrong", "not_relevant", "too_strict", "too_loose", "already_enforced", "duplicate", "other")

# ---- fixed values: the 18 checks -----------------------------------------------------------------
# check type -> (allowed scopes, fewest target columns, most target columns or None)
CHECKS = {
    "not_null": (("column",), 1, 1),
    "null_rate_max": (("column",), 1, 1),
    "unique": (("column", "table"), 1, None),
    "allowed_values": (("column",), 1, 1),
    "pattern": (("column",), 1, 1),
    "range": (("column",), 1, 1),
    "length_range": (("column",), 1, 1),
    "date_not_future": (("column",), 1, 1),
    "not_placeholder": (("column",), 1, 1),
    "row_condition": (("row",), 1, None),
    "conditional": (("row",), 1, None),
    "foreign_key": (("cross_table",), 1, None),
    "has_children": (("cross_table",), 0, None),
    "aggregate_compare": (("cross_table",), 0, None),
    "hierarchy_parent_level": (("table",), 0, None),
    "hierarchy_acyclic": (("table",), 0, None),
    "hierarchy_attach_level": (("cross_table",), 1, 1),
    "custom_sql": (SCOPES, 0, None),
}
# check type -> parameters it takes: (required, optional)
CHECK_PARAMETERS = {
    "not_null": ((), ()),
    "null_rate_max": (("max_rate",), ()),
    "unique": ((), ()),
    "allowed_values": (("values",), ("case_sensitive",)),
    "pattern": (("regex",), ()),
    "range": ((), ("min", "max", "inclusive")),
    "length_range": ((), ("min_length", "max_length")),
    "date_not_future": ((), ()),
    "not_placeholder": (("values",), ()),
    "row_condition": (("expression",), ()),
    "conditional": (("when", "then"), ()),
    "foreign_key": (("ref_entity", "ref_columns"), ()),
    "has_children": (("child_entity", "child_join_columns", "parent_join_columns"), ("min_children",)),
    "aggregate_compare": (("child_entity", "child_join_columns", "parent_join_columns", "child_expression",
                           "operator", "parent_expression"), ("tolerance_abs",)),
    "hierarchy_parent_level": (("hierarchy",), ()),
    "hierarchy_acyclic": (("hierarchy",), ()),
    "hierarchy_attach_level": (("hierarchy", "level"), ()),
    "custom_sql": (("sql",), ()),
}
# check family used when one rule is compared with another
CHECK_FAMILY = {
    "not_null": "completeness", "null_rate_max": "completeness", "allowed_values": "allowed", "pattern": "format",
    "length_range": "format", "range": "range", "unique": "unique", "date_not_future": "future",
    "not_placeholder": "placeholder", "row_condition": "row", "conditional": "row", "foreign_key": "fk",
    "has_children": "children", "aggregate_compare": "aggregate", "hierarchy_parent_level": "h_parent",
    "hierarchy_acyclic": "h_acyclic", "hierarchy_attach_level": "h_attach", "custom_sql": "custom",
}

# ---- fixed values: profiling ---------------------------------------------------------------------
TOP_VALUES = 50
TOP_PATTERNS = 10
PATTERN_COVERAGE = 0.5
FORMAT_MIN_RATE = 0.8
PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
FENCE = 3.0
PLACEHOLDER_DATES = ("1900-01-01", "1899-12-31", "1970-01-01", "9999-12-31", "2099-12-31")
TRUE_WORDS = ("1", "true", "t", "y", "yes")
FALSE_WORDS = ("0", "false", "f", "n", "no")
FORMATS = (
    ("email", r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$"),
    ("uuid", r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"),
    ("url", r"^https?://\S+$"),
    ("iso_datetime", r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}"),
    ("iso_date", r"^\d{4}-\d{2}-\d{2}$"),
    ("phone", r"^\+?[0-9][0-9 ()-]{7,16}$"),
    ("decimal_text", r"^-?\d+\.\d+$"),
    ("integer_text", r"^-?\d+$"),
    ("code", r"^[A-Z0-9]+([-_][A-Z0-9]+)*$"),
)
EMAIL_REGEX = FORMATS[0][1]
SENSITIVE_FORMATS = ("email", "phone")
SENSITIVE_NAME = (r"(first|last|middle|full|given|sur|customer|contact|person|user)_?name"
                  r"|e_?mail|phone|mobile|address|birth|\bdob\b|ssn|aadhaar|passport|pan_?(no|number)|salary")
PII_NAME = r"gender|(^|_)sex($|_)|ethnic|religion|nationality|marital"

# ---- fixed values: semantic inference ------------------------------------------------------------
REVIEW_BELOW = 0.9
CANONICAL_SHARE = 0.01
STYLE_SHARE = 0.003
DOMINANT_PATTERN = 0.95
NEAR_UNIQUE = 0.95
FORMAT_HINTS = {"email": "email", "phone": "phone", "url": "url", "uuid": "identifier"}
# (group, pattern on the snake_case name, semantic type, weight); the first match of a group counts
NAME_HINTS = (
    ("contact", r"(^|_)e_?mail(_|$)", "email", 3.0),
    ("contact", r"(^|_)(phone|mobile|tel|telephone|cell)(_|$)", "phone", 3.0),
    ("contact", r"(^|_)(address|street|addr)(_|$)", "address", 3.0),
    ("contact", r"(^|_)(zip|pin|postal|postcode|pincode)(_|$)", "postal_code", 3.0),
    ("contact", r"(^|_)(url|website|link)(_|$)", "url", 3.0),
    ("name", r"(^|_)(first|last|middle|given|sur|full)_?name$|^(customer|contact|person|employee)_name$",
     "person_name", 3.0),
    ("name", r"(^|_)(company|org|organization|organisation|supplier|vendor)_name$", "organization_name", 3.0),
    ("name", r"(desc|description|remarks?|notes?|comments?)$", "description", 2.5),
    ("name", r"(_name|_title)$|^(name|title)$", "label", 2.0),
    ("date", r"(^|_)(dob|birth_?date|date_of_birth|birthday)(_|$)", "birth_date", 3.0),
    ("date", r"(_at|_ts|_time|_timestamp|_datetime)$", "event_timestamp", 2.0),
    ("date", r"(_date|_dt|_on|_day)$|^date_", "event_date", 2.0),
    ("number", r"(_pct|_percent|_percentage|_perc)$|^(pct|percent)_", "percentage", 3.0),
    ("number", r"(^|_)cost(_|$)", "cost", 3.0),
    ("number", r"(^|_)(price|mrp)(_|$)", "price", 3.0),
    ("number", r"(^|_)(qty|quantity|units)(_|$)", "quantity", 3.0),
    ("number", r"(^|_)(amount|amt|total|revenue|sales|balance|fee|charge|tax|value)(_|$)", "amount", 2.5),
    ("number", r"(_rate|_ratio)$", "rate", 2.0),
    ("number", r"(_count|_cnt)$|^(num|no_of|count)_", "count", 2.0),
    ("code", r"(^|_)(currency|ccy)(_code)?$", "currency_code", 3.0),
    ("code", r"(^|_)country(_code)?$", "country_code", 3.0),
    ("code", r"(^|_)status$", "status_code", 3.0),
    ("code", r"(^|_)(level|tier|depth|rank)$", "hierarchy_level", 3.0),
    ("code", r"(type|category|segment|class|group|channel|method|mode|gender|kind)$", "category_code", 2.5),
    ("flag", r"^(is|has|can|should|was)_|(_flag|_yn|_ind)$", "flag", 3.0),
    ("key", r"(^|_)(sku|code|number|no|ref|reference)$", "business_key", 1.5),
)
NAME_HINT_GROUPS = ("contact", "name", "date", "number", "code", "flag", "key")
CONTAINMENT = 0.9
ATTACH_SHARE = 0.9
LEVEL_LINK_SHARE = 0.5
MANDATORY_NULL_RATE = 0.02
REFERENCE_ROWS = 1000
ROOT, MISSING = "__root__", "__missing__"

# ---- fixed values: recommendation, review, scoring ----------------------------------------------
BIRTH_PLACEHOLDERS = ("1900-01-01", "1899-12-31", "1970-01-01", "9999-12-31")
NUMERIC_FLOORS = {"price": (0, False), "cost": (0, True), "quantity": (0, False)}
HIGH_FAILURE_RATE = 0.10
RULE_BUDGET = 12
REPEAT_BUDGET = 5
WELL_COVERED = 20
PATTERN_MIN_DECISIONS = 2
SOURCE_MIN_REJECTIONS = 3
CAUGHT_SHARE = 0.5
RARE_SHARE = 0.02
DOMINANT_SHARE = 0.9
SIGNALS_BY_DIMENSION = {
    "completeness": ("nulls",),
    "validity": ("rare_values", "minority_patterns", "format_mismatch", "negatives", "zeros"),
    "uniqueness": ("near_unique",),
    "referential_integrity": ("orphans",),
    "accuracy": ("placeholders", "outliers", "rare_values"),
    "timeliness": ("future_dates",),
    "consistency": (),
    "business_rule": (),
    "hierarchy": (),
}
LOCKED_RULE_FIELDS = ("rule_id", "source_id", "origin", "generation_run_id", "model", "status", "reviews",
                      "created_at", "fingerprint", "similarity_key")
EXPRESSION_PARAMETERS = ("expression", "when", "then", "child_expression", "parent_expression", "sql")
RELATED_PARAMETERS = ("ref_entity", "child_entity", "hierarchy")

# ---- fixed values: functions allowed inside rule expressions --------------------------------------
ROW_FUNCTIONS = ("abs", "round", "coalesce", "upper", "lower", "length", "date_add", "and", "or", "not", "in",
                 "trim", "cast", "year", "month", "day", "floor", "ceil", "substring", "concat", "nullif",
                 "add_months", "date", "to_date", "if", "ifnull")
AGGREGATE_FUNCTIONS = ("sum", "min", "max", "count", "avg")
