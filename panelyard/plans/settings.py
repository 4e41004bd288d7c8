"""Fixed values of the two index studies. They are parameters of the published models
and have to be these values for the results to be the same."""

# Slopes of the ratio index, fitted value and 95% limits.
RATIO_COEFS = {
    "fit": {"gdppc": 0.152002, "urbanization": 0.147856, "education": 11.235020},
    "low": {"gdppc": 0.131, "urbanization": 0.0954, "education": 9.36},
    "high": {"gdppc": 0.173, "urbanization": 0.200, "education": 13.1},
}

# Slope of the level index and the standard error behind its limits.
LEVEL_SLOPE = 0.956268
LEVEL_STD_ERROR = 0.06368845

# Bounds of the min-max normalisation per variable.
NORMAL_BOUNDS = {
    "gdppc": (102.598, 189422.2),
    "urbanization": (5.491, 98.139),
    "share_employed_agri": (0.13, 92.37),
}

# Income-group cutoffs on the log index.
RATIO_CUTOFFS_ALL = [
    ("High income", 3.16),
    ("Low income", -0.182),
    ("Lower middle income", 0.79),
    ("Upper middle income", 1.48),
]
RATIO_CUTOFFS = [("High income", 3.16), ("Lower middle income", 0.79), ("Upper middle income", 1.48)]
LEVEL_CUTOFFS = [("Lower middle income", 3.57), ("Upper middle income", 5.08), ("High income", 6.37)]

# Order of the income groups on the charts.
INCOME_LEVELS = ["Lower middle income", "Upper middle income", "High income"]

# Fixed values: (regions, cutoff) lines left off the charts.
RATIO_HIDDEN = [
    (
        ["Central Asia", "East Asia & Pacific", "Europe", "North America",
         "Latin America & Caribbean", "Middle East & North Africa"],
        "Lower middle income",
    ),
    (["Europe", "North America"], "Upper middle income"),
]
LEVEL_HIDDEN = [
    (
        ["Central Asia", "East Asia & Pacific", "North America",
         "Latin America & Caribbean", "Middle East & North Africa"],
        "Lower middle income",
    ),
]

# Entity left out of the ratio index, and entities without usable drivers
# that are left out of its projection.
RATIO_DROPPED = "ARG"
RATIO_NOT_PROJECTED = [
    "ARG", "AUT", "BHR", "BHS", "BLZ", "BRB", "COD", "COM", "CUB", "DJI",
    "GAB", "GRD", "GTM", "GUY", "HKG", "HTI", "KGZ", "KWT", "LBR", "LBY",
    "LCA", "LSO", "MRT", "PNG", "SDN", "SGP", "SLB", "SOM", "SRB", "STP",
    "SWZ", "SYR", "TJK", "TLS", "TON", "TUR", "UGA", "UZB", "WSM", "AGO",
    "BRN", "BWA", "ERI", "FJI", "ISR", "LKA", "OMN", "PSE", "TGO", "YEM",
]

# Periods.
BASELINE_YEARS = (2000, 2010)
BASELINE_AT = 2005
SCENARIO_GRID = (2020, 2100, 5)
LAST_OBSERVED = 2019
MILESTONES = (2035, 2050, 2075, 2100)

# Scenarios in the report, and those left off the main charts.
REPORT_SCENARIOS = ["SSP1", "SSP2", "SSP3"]
HIDDEN_SCENARIOS = ["SSP4", "SSP5"]
