"""Fixed lookup values of the time-use survey.

Everything here is a published constant of the survey: code names, curated category
patterns, income brackets, state names. The tables are tiny and never grow with the
data, so they are safe to broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# They must equal the published survey definitions.
# ---------------------------------------------------------------------------

# regular expression over the activity code -> curated category (estimates)
CATEGORIES_V1 = (
    ("t0101.*", "Sleep"),
    ("t010[2-9].*", "Personal Care"),
    ("t019.*", "Personal Care"),
    ("t1801.*", "Personal Care"),
    ("t02.*", "Household Activities"),
    ("t1802.*", "Household Activities"),
    ("t03.*", "Caring For Household Member"),
    ("t1803.*", "Caring For Household Member"),
    ("t04.*", "Caring For Nonhousehold Members"),
    ("t1804.*", "Caring For Nonhousehold Members"),
    ("t05.*", "Work"),
    ("t1805.*", "Work"),
    ("t06.*", "Education"),
    ("t1806.*", "Education"),
    ("t07.*", "Consumer Purchases"),
    ("t1807.*", "Consumer Purchases"),
    ("t08.*", "Professional & Personal Care Services"),
    ("t1808.*", "Professional & Personal Care Services"),
    ("t09.*", "Household Services"),
    ("t1809.*", "Household Services"),
    ("t10.*", "Other"),
    ("t1810.*", "Other"),
    ("t11.*", "Eating and Drinking"),
    ("t1811.*", "Eating and Drinking"),
    ("t12.*", "Socializing, Relaxing, and Leisure"),
    ("t1812.*", "Socializing, Relaxing, and Leisure"),
    ("t13.*", "Sports, Exercise, and Recreation"),
    ("t1813.*", "Sports, Exercise, and Recreation"),
    ("t14.*", "Religious and Volunteer Activities"),
    ("t1814.*", "Religious and Volunteer Activities"),
    ("t15.*", "Religious and Volunteer Activities"),
    ("t1815.*", "Religious and Volunteer Activities"),
    ("t16.*", "Other"),
    ("t1816.*", "Other"),
    ("t1818.*", "Other"),
    ("t1819.*", "Other"),
    ("t189.*", "Other"),
    ("t50.*", "Other"),
)

# the same patterns where the sequence and clustering inputs name them differently
_V2_CHANGES = {
    "t09.*": "Other",
    "t1809.*": "Other",
    "t14.*": "Religious and Spiritual",
    "t1814.*": "Religious and Spiritual",
    "t15.*": "Volunteer",
    "t1815.*": "Volunteer",
}
CATEGORIES_V2 = tuple((p, _V2_CHANGES.get(p, d)) for p, d in CATEGORIES_V1)

# pattern of the data-quality codes that category totals leave out
DATA_CODES_PATTERN = "t50.*"

# categories spent mostly at home
HOME_CATEGORIES = (
    "Sleep",
    "Personal Care",
    "Household Activities",
    "Caring For Household Member",
    "Eating and Drinking",
    "Socializing, Relaxing, and Leisure",
)

TV_CODES = ("t120303", "t120304")
COOKING_CODES = ("t020201", "t020202", "t020203", "t020299")
GROCERY_CODES = ("t070101", "t180701")
JOB_SEARCH_CODES = ("t050401", "t050403", "t050404", "t050405", "t050499", "t180504")
COMPUTER_LEISURE_CODE = "t120308"
SPORTS_CODE_RANGE = ("t130101", "t130199")

# family income code -> lower end of the bracket in dollars
INCOME_FLOORS = (
    (1, 0.0),
    (2, 5000.0),
    (3, 7500.0),
    (4, 10000.0),
    (5, 12500.0),
    (6, 15000.0),
    (7, 20000.0),
    (8, 25000.0),
    (9, 30000.0),
    (10, 35000.0),
    (11, 40000.0),
    (12, 50000.0),
    (13, 60000.0),
    (14, 75000.0),
    (15, 100000.0),
    (16, 150000.0),
)

# first code of each of the five wide income brackets, with its label
INCOME_BRACKETS = (
    (1, 7, "$0-25k"),
    (8, 11, "$25-50k"),
    (12, 14, "$50-100k"),
    (15, 15, "$100-150k"),
    (16, 16, "$150k+"),
)

# wording removed from the names of waiting activities, in this order
WAITING_PREFIXES = (
    "Waiting associated with ",
    "Waiting associated w/",
    "Waiting assoc. w/",
    "Waiting related to ",
    "Waiting for/",
)

TIER1_NAMES = (
    ("01", "Personal Care"),
    ("02", "Household Activities"),
    ("03", "Caring For & Helping Household (HH) Member"),
    ("04", "Caring For & Helping Nonhousehold (NonHH) Members"),
    ("05", "Work & Work Related Activities"),
    ("06", "Education"),
    ("07", "Consumer Purchases"),
    ("08", "Professional & Personal Care Services"),
    ("09", "Household Services"),
    ("10", "Government Services & Civic Obligations"),
    ("11", "Eating and Drinking"),
    ("12", "Socializing, Relaxing, and Leisure"),
    ("13", "Sports Exercise and Recreation"),
    ("14", "Religious and Spiritual Activities"),
    ("15", "Volunteer Activities"),
    ("16", "Telephone Calls"),
    ("18", "Traveling"),
    ("50", "Data Codes"),
)

# state name, postal code, FIPS number
STATES = (
    ("Alabama", "AL", 1),
    ("Alaska", "AK", 2),
    ("Arizona", "AZ", 4),
    ("Arkansas", "AR", 5),
    ("California", "CA", 6),
    ("Colorado", "CO", 8),
    ("Connecticut", "CT", 9),
    ("Delaware", "DE", 10),
    ("Florida", "FL", 12),
    ("Georgia", "GA", 13),
    ("Hawaii", "HI", 15),
    ("Idaho", "ID", 16),
    ("Illinois", "IL", 17),
    ("Indiana", "IN", 18),
    ("Iowa", "IA", 19),
    ("Kansas", "KS", 20),
    ("Kentucky", "KY", 21),
    ("Louisiana", "LA", 22),
    ("Maine", "ME", 23),
    ("Maryland", "MD", 24),
    ("Massachusetts", "MA", 25),
    ("Michigan", "MI", 26),
    ("Minnesota", "MN", 27),
    ("Mississippi", "MS", 28),
    ("Missouri", "MO", 29),
    ("Montana", "MT", 30),
    ("Nebraska", "NE", 31),
    ("Nevada", "NV", 32),
    ("New Hampshire", "NH", 33),
    ("New Jersey", "NJ", 34),
    ("New Mexico", "NM", 35),
    ("New York", "NY", 36),
    ("North Carolina", "NC", 37),
    ("North Dakota", "ND", 38),
    ("Ohio", "OH", 39),
    ("Oklahoma", "OK", 40),
    ("Oregon", "OR", 41),
    ("Pennsylvania", "PA", 42),
    ("Rhode Island", "RI", 44),
    ("South Carolina", "SC", 45),
    ("South Dakota", "SD", 46),
    ("Tennessee", "TN", 47),
    ("Texas", "TX", 48),
    ("Utah", "UT", 49),
    ("Vermont", "VT", 50),
    ("Virginia", "VA", 51),
    ("Washington", "WA", 53),
    ("West Virginia", "WV", 54),
    ("Wisconsin", "WI", 55),
    ("Wyoming", "WY", 56),
    ("American Samoa", "AS", 60),
    ("Guam", "GU", 66),
    ("Northern Mariana Islands", "MP", 69),
    ("Puerto Rico", "PR", 72),
    ("Virgin Islands", "VI", 78),
)

# division, state, region
STATE_REGIONS = (
    ("MidAtlantic", "New Jersey", "Northeast"),
    ("MidAtlantic", "New York", "Northeast"),
    ("MidAtlantic", "Pennsylvania", "Northeast"),
    ("NewEngland", "Connecticut", "Northeast"),
    ("NewEngland", "Maine", "Northeast"),
    ("NewEngland", "Massachusetts", "Northeast"),
    ("NewEngland", "New Hampshire", "Northeast"),
    ("NewEngland", "Rhode Island", "Northeast"),
    ("NewEngland", "Vermont", "Northeast"),
    ("ENCentral", "Indiana", "Midwest"),
    ("ENCentral", "Illinois", "Midwest"),
    ("ENCentral", "Michigan", "Midwest"),
    ("ENCentral", "Ohio", "Midwest"),
    ("ENCentral", "Wisconsin", "Midwest"),
    ("WNCentral", "Iowa", "Midwest"),
    ("WNCentral", "Kansas", "Midwest"),
    ("WNCentral", "Minnesota", "Midwest"),
    ("WNCentral", "Missouri", "Midwest"),
    ("WNCentral", "Nebraska", "Midwest"),
    ("WNCentral", "North Dakota", "Midwest"),
    ("WNCentral", "South Dakota", "Midwest"),
    ("SAtlantic", "Delaware", "South"),
    ("SAtlantic", "District of Columbia", "South"),
    ("SAtlantic", "Florida", "South"),
    ("SAtlantic", "Georgia", "South"),
    ("SAtlantic", "Maryland", "South"),
    ("SAtlantic", "North Carolina", "South"),
    ("SAtlantic", "South Carolina", "South"),
    ("SAtlantic", "Virginia", "South"),
    ("SAtlantic", "West Virginia", "South"),
    ("ESCentral", "Alabama", "South"),
    ("ESCentral", "Kentucky", "South"),
    ("ESCentral", "Mississippi", "South"),
    ("ESCentral", "Tennessee", "South"),
    ("WSCentral", "Arkansas", "South"),
    ("WSCentral", "Louisiana", "South"),
    ("WSCentral", "Oklahoma", "South"),
    ("WSCentral", "Texas", "South"),
    ("Mountain", "Arizona", "West"),
    ("Mountain", "Colorado", "West"),
    ("Mountain", "Idaho", "West"),
    ("Mountain", "New Mexico", "West"),
    ("Mountain", "Montana", "West"),
    ("Mountain", "Utah", "West"),
    ("Mountain", "Nevada", "West"),
    ("Mountain", "Wyoming", "West"),
    ("Pacific", "Alaska", "West"),
    ("Pacific", "California", "West"),
    ("Pacific", "Hawaii", "West"),
    ("Pacific", "Oregon", "West"),
    ("Pacific", "Washington", "West"),
)

# ---------------------------------------------------------------------------
# The same values as small DataFrames
# ---------------------------------------------------------------------------

def category_patterns(spark: SparkSession, patterns=CATEGORIES_V1) -> DataFrame:
    return spark.createDataFrame(list(patterns), "pattern string, description string")


def income_floors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(INCOME_FLOORS), "income_code int, hh_income double")


def income_brackets(spark: SparkSession) -> DataFrame:
    """Bracket floor in dollars with its printed label and position."""
    floors = dict(INCOME_FLOORS)
    rows = [(floors[lo], label, i) for i, (lo, _, label) in enumerate(INCOME_BRACKETS, 1)]
    return spark.createDataFrame(rows, "hh_income double, income_label string, income_rank int")


def tier1_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TIER1_NAMES), "code string, description string")


def states(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STATES), "name string, state string, fips int")


def state_regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STATE_REGIONS), "division string, state string, region string")
