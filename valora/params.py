"""Parameters and fixed values.

Everything under "FIXED VALUES" must equal the values the original valuation
tool uses, so that results agree; they are stated here plainly, once.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the original tool for equal results)
# ---------------------------------------------------------------------------

CITY_CENTER_LAT = 37.7749
CITY_CENTER_LON = -122.4194
CELL_RESOLUTION = 9  # nominal ~0.1 km2 cells

STATIONS = [
    ("Embarcadero", 37.7929, -122.3968),
    ("Montgomery", 37.7894, -122.4013),
    ("Powell", 37.7844, -122.4078),
    ("Civic Center", 37.7796, -122.4139),
    ("16th St Mission", 37.7650, -122.4194),
    ("24th St Mission", 37.7522, -122.4182),
    ("Glen Park", 37.7329, -122.4343),
    ("Balboa Park", 37.7219, -122.4474),
]

FEATURES_CORE = ["sqft", "bedrooms", "year_built", "condition"]
FEATURES_V2_2 = FEATURES_CORE + [
    "property_age", "sqft_per_bedroom", "is_newer_construction",
    "distance_to_downtown_km", "distance_to_nearest_bart_km",
    "neighborhood_price_tier",
]
FEATURES_V3 = FEATURES_V2_2 + [
    "h3_median_ppsf", "h3_neighbor_median_ppsf", "h3_listing_density",
    "h3_price_percentile",
]
FEATURES_V3_FULL = FEATURES_V3 + ["walk_score", "transit_score", "bike_score"]
TARGET = "price"

BOOSTER_DEFAULTS = {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.1, "seed": 42}
TUNING_TRIALS = 50
TUNING_PARALLELISM = 8
TUNING_SPACE = {
    "learning_rate": (0.01, 0.3, "log"),
    "max_depth": (3, 10, "int"),
    "subsample": (0.6, 1.0, "float"),
    "n_estimators": (50, 300, "int"),
    "min_child_weight": (1, 10, "int"),
    "colsample_bytree": (0.5, 1.0, "float"),
}

CHUNK_SIZE = 500
CHUNK_OVERLAP = 50
TOP_K = 3

VALIDATION = {
    "price_min": 0, "price_max": 100_000_000,
    "sqft_min": 100, "sqft_max": 50_000,
    "bedrooms_min": 0, "bedrooms_max": 20,
    "year_built_min": 1800,
    "condition_min": 1, "condition_max": 5,
}

CONDITION_LABELS = {1: "Poor", 2: "Fair", 3: "Average", 4: "Good", 5: "Excellent"}

# Mortgage context
CURRENT_RATES = {"30_year_fixed": 6.89, "15_year_fixed": 6.12, "5_1_arm": 6.25,
                 "last_updated": "2025-01-09", "source": "Freddie Mac PMMS"}
RATE_HISTORY = {"one_year_ago": 6.66, "two_years_ago": 6.33, "five_years_ago": 3.65,
                "ten_year_avg": 4.25, "historical_low": 2.65, "historical_high": 18.63}
RATE_IMPACT = [
    # environment, sentiment, buyer_impact, seller_impact, investment_note
    ("high", "Challenging", "Significantly reduced purchasing power",
     "Longer days on market expected", "Focus on cash flow, not appreciation"),
    ("elevated", "Cautious", "Reduced affordability vs 2021-2022",
     "Price sensitivity increasing", "Negotiate aggressively, expect slower appreciation"),
    ("moderate", "Balanced", "Moderate affordability pressure",
     "Normal market dynamics", "Standard underwriting applies"),
    ("favorable", "Bullish", "Strong purchasing power",
     "Multiple offers likely", "Act quickly, expect competition"),
]
PROPERTY_TAX_RATE = 0.0115
INSURANCE_RATE = 0.003

# Text signals
BULLISH_KEYWORDS = ["growth", "appreciation", "demand", "resilience", "premium", "up"]
BEARISH_KEYWORDS = ["decline", "risk", "challenge", "vacancy", "concern", "down"]
POTENTIAL_RISKS = ["Office vacancy", "Interest rate sensitivity", "Supply increase",
                   "Rent control expansion", "Market volatility", "Commercial exodus"]
INJECTION_PATTERNS = ["ignore previous", "ignore all", "disregard", "system prompt",
                      "reveal your instructions", "forget everything"]

# Model token limits and costs per 1K tokens: model, input_limit, output_limit,
# input_cost_1k, output_cost_1k
MODEL_LIMITS = [
    ("gpt-5.2", 128000, 8000, 0.00175, 0.014),
    ("gpt-5", 128000, 8000, 0.00125, 0.010),
    ("gpt-5-mini", 64000, 4000, 0.00025, 0.002),
    ("gpt-5-nano", 32000, 2000, 0.00005, 0.0004),
    ("gpt-4.1", 128000, 8000, 0.002, 0.008),
    ("gpt-4.1-mini", 64000, 4000, 0.0004, 0.0016),
    ("gpt-4.1-nano", 32000, 2000, 0.0001, 0.0004),
    ("gpt-4o-mini", 128000, 4000, 0.00015, 0.0006),
    ("gpt-4o", 128000, 8000, 0.0025, 0.010),
    ("gpt-4-turbo", 128000, 4096, 0.01, 0.03),
    ("gpt-3.5-turbo", 16000, 4096, 0.0005, 0.0015),
]
DEFAULT_LIMITS = (4000, 1000)
DEFAULT_COSTS = (0.001, 0.002)

# Static neighbourhood market news: zip, neighborhood, sentiment, news, risk_factors
MARKET_NEWS = [
    ("94102", "Tenderloin/Civic Center", "Bearish",
     ["City proposes new affordable housing mandates affecting investor returns",
      "Homeless services expansion planned for 2024",
      "Tech company announces office closure nearby"],
     ["High crime rate", "Rent control pressure", "Commercial vacancy"]),
    ("94103", "SoMa", "Neutral",
     ["Mixed-use development approved on Folsom Street",
      "Transit improvements planned for 2025",
      "Some tech companies returning to office"],
     ["Market volatility", "Zoning changes pending"]),
    ("94104", "Financial District", "Bearish",
     ["Office-to-residential conversions gaining momentum",
      "Major bank reducing downtown footprint",
      "Daytime foot traffic down 40% from 2019 levels"],
     ["Commercial exodus", "Structural market shift"]),
    ("94105", "Rincon Hill/South Beach", "Bullish",
     ["New waterfront park opening increases desirability",
      "Luxury condo sales up 15% YoY",
      "Oracle Park events driving local economy"],
     ["High HOA fees", "Earthquake liquefaction zone"]),
    ("94107", "Potrero Hill/Dogpatch", "Bullish",
     ["Biotech hub expansion creating jobs",
      "Historic warehouse conversions in demand",
      "New MUNI line improves connectivity"],
     ["Limited parking", "Industrial adjacency"]),
    ("94109", "Nob Hill/Russian Hill", "Stable",
     ["Historic preservation status limits new supply",
      "Cable car renovation completed",
      "Luxury rental market stabilizing"],
     ["Limited appreciation potential", "Aging building stock"]),
    ("94110", "Mission District", "Neutral",
     ["Small business revival gaining momentum",
      "Cultural district designation approved",
      "Gentrification concerns continue"],
     ["Political intervention risk", "Rent control"]),
    ("94114", "Castro", "Stable",
     ["Neighborhood retail occupancy improving",
      "Historic building renovation incentives available",
      "Strong community investment continues"],
     ["Limited inventory", "High entry price"]),
    ("94115", "Pacific Heights", "Bullish",
     ["Billionaires Row sees continued demand",
      "Trophy property sold for $30M+",
      "Private school enrollment driving family demand"],
     ["Ultra-high price point", "Limited buyer pool"]),
    ("94117", "Haight-Ashbury", "Neutral",
     ["Tourism recovery boosting local businesses",
      "Victorian restoration projects active",
      "Parking challenges persist"],
     ["Tourist impact", "Older housing stock"]),
]
DEFAULT_MARKET_NEWS = (
    "Greater San Francisco", "Neutral",
    ["Regional housing market showing mixed signals",
     "Interest rates impacting buyer behavior",
     "Inventory levels below historical average"],
    ["Market uncertainty", "Rate sensitivity"],
)
DEFAULT_NEIGHBORHOOD = "Greater San Francisco"

# Walk score API status messages
WALKSCORE_STATUS = {
    2: "Score being calculated, try again later",
    30: "Invalid latitude/longitude",
    31: "Walk Score not available for this location",
    40: "Invalid API key",
    41: "API quota exceeded (5,000/day limit)",
    42: "IP address blocked - contact Walk Score support",
}

# ---------------------------------------------------------------------------
# Explicit parameters (wall-clock years made deterministic)
# ---------------------------------------------------------------------------
FEATURE_YEAR = 2025   # year used by derived features (age)
CURRENT_YEAR = 2025   # year used by validation and condition imputation

# Hex grid (own axial grid, not H3-compatible): edge length in km
HEX_EDGE_KM = 0.2
KM_PER_DEG_LAT = 110.574
KM_PER_DEG_LON_EQ = 111.320
EARTH_RADIUS_KM = 6371.0
CELL_OFFSET = 1 << 20
