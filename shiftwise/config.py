"""Label sets and names shared by every report.

The labels are values stored in the source tables, so they are fixed: they
must be spelled exactly as below for the counts to be right.
"""

# --- Fixed values (must equal the stored labels) -------------------------
GP_ADVICE = "GP Advice"
ADVICE = "Advice"
NWAS_TRIAGE = "NWAS Triage"
TREATMENT_CENTRE = "Treatment Centre"
CAS_TREATMENT_CENTRE = "CAS Treatment Centre - BARDOC"
VISIT = "Visit"
HMR_VH_VISIT = "HMR VH Visit"
CALL_HANDLER_ROLE = "Call Handler"
INBOUND = "INBOUND"
ALL_OPTION = "(All)"
# Text order of names in a sorted report: root order of the Unicode collation
# algorithm (the database's own is not known; "UTF8_BINARY" is byte order).
NAME_COLLATION = "UNICODE"
# --------------------------------------------------------------------------

# Advice types ("A"): counted as advice, and as "advice stays advice" when
# the next consultation is also one of them.
ADVICE_TYPES = (GP_ADVICE, ADVICE)
# Advice types plus triage: only used for the average advice duration.
ADVICE_OR_TRIAGE_TYPES = (GP_ADVICE, ADVICE, NWAS_TRIAGE)
TREATMENT_CENTRE_TYPES = (TREATMENT_CENTRE, CAS_TREATMENT_CENTRE)
VISIT_TYPES = (VISIT, HMR_VH_VISIT)
# The seven types that make a consultation count in the clinician reports.
COUNTED_TYPES = ADVICE_OR_TRIAGE_TYPES + TREATMENT_CENTRE_TYPES + VISIT_TYPES

# Single labels counted per hour in the hourly activity report, in output
# column order: (output column, label).
HOURLY_TYPE_COLUMNS = (
    ("gp_advice_consults", GP_ADVICE),
    ("advice_consults", ADVICE),
    ("visit", VISIT),
    ("treatment_centre", TREATMENT_CENTRE),
    ("nwas_triage", NWAS_TRIAGE),
)

# Series of the hourly activity chart (wide -> long), in trace order.
HOURLY_CHART_SERIES = (
    "num_calls",
    "gp_advice_consults",
    "advice_consults",
    "visit",
    "treatment_centre",
)
