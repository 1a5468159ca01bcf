"""Labels that appear in result tables, kept equal to the published result format."""

# Eligibility scenarios.
EARLY = "early_entry"
LATER = "later_entry"
ANY = "any_prenatal_care"
NONE = "no_care"
UNKNOWN = "unknown_care"
ALL = "all_record_upper_bound"

# Selection protocols.
TOP_FRACTION = "cohort_specific_top_fraction"
FIXED_BUDGET = "fixed_absolute_budget"
FIXED_THRESHOLD = "fixed_calibration_threshold"
PROTOCOLS = (TOP_FRACTION, FIXED_BUDGET, FIXED_THRESHOLD)

# Scenario pairs that are compared, from -> to.
PAIRS = ((EARLY, ANY), (ANY, ALL), (EARLY, ALL))

# Scenarios of the condition grid.
AVAILABLE = "available_subset"
POPULATION = "all_population"

#: Selected shares reported by default.
FRACTIONS = (0.05, 0.1)
