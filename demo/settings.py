"""Period and filter values of the registered queries."""

START = "2024-01-03"
END = "2024-01-28"
DAY = "2024-01-10"
COUNTRY = "NATION_19"
COUNTRIES = ("NATION_19", "NATION_10", "NATION_3")
ASN = "NET_1"
ASNS = ["NET_1", "NET_4", "NET_404"]
IP = "10.0.0.1"
USERNAME = "click_3"
HIDDEN = ("NATION_19", "NATION_12")
RANK_METRICS = ["total_attacks", "max_pct_change", "first_seen"]

# Period of the long log, about 2,500 days of shipments.
WIDE_START = "1996-03-01"
WIDE_END = "1999-12-20"

# The day after DAY, and a period that holds the whole log.
NEXT_DAY = "2024-01-11"
WHOLE_LOG = ("2023-12-01", "2024-03-31")

# Texts of every length a search tells apart.
SEARCHES = ("1", "0.", "0.1", "CK_", "click", "10.0.0.2", "no such name", "")
