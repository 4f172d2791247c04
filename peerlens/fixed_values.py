"""Names and codes that filings and reports use as they are."""

# fixed values: state or union territory -> zone
ZONE_OF_STATE = {
    "Delhi": "North", "Uttar Pradesh": "North", "Haryana": "North", "Punjab": "North", "Rajasthan": "North",
    "Uttarakhand": "North", "Chandigarh": "North", "Himachal Pradesh": "North", "Jammu & Kashmir": "North", "Ladakh": "North",
    "Karnataka": "South", "Tamil Nadu": "South", "Kerala": "South", "Puducherry": "South",
    "Andaman and Nicobar Islands": "South", "Lakshadweep": "South",
    "West Bengal": "East", "Bihar": "East", "Jharkhand": "East", "Assam": "East", "Tripura": "East", "Manipur": "East",
    "Meghalaya": "East", "Arunachal Pradesh": "East", "Nagaland": "East", "Sikkim": "East", "Mizoram": "East",
    "Maharashtra": "West", "Gujarat": "West", "Goa": "West", "Daman & Diu": "West", "Dadra and Nagar Haveli": "West",
    "Telangana": "Central", "Madhya Pradesh": "Central", "Andhra Pradesh": "Central", "Odisha": "Central", "Chhattisgarh": "Central",
}
NAMED_STATES = ["Uttar Pradesh", "Maharashtra", "Karnataka", "Haryana", "Tamil Nadu", "Kerala", "Delhi"]

# investment category code -> bucket
CODE_BUCKETS = {
    "Govt Bonds": ["CGSB", "CGSL", "CTRB", "SGGB", "SGGL", "CSGB", "CSPD", "CDSS"],
    "Corporate Bonds/Debentures": [
        "SGOA", "HTDN", "HTDA", "HTLN", "HTHD", "ICCP", "IPTD", "ICTD", "ICFD", "IDDF", "EPBT", "ILBI", "ECOS", "ECCP",
        "HORD", "IODS", "IORD", "OLDB", "HODS", "EINP", "EUPD", "EPPD", "ECBO", "EDPG", "ORAD", "HDPG", "EAPB", "EAPS"],
    "Deposits": ["ECDB", "EDCD", "ECMR"],
    "Equity/Invits/REIT": ["ECAM", "OEPU", "EAEQ", "ERIT", "OIIT", "EETF", "OETF", "EIIT", "ODCI", "IDIT", "EDRT",
                           "OAFB", "OESH", "EACE", "ITCE", "ITPE"],
    "Mutual Funds": ["EGMF", "EMPG", "OMGS"],
}

# channel bucket -> fragments of its folded label
CHANNEL_FRAGMENTS = {
    "Individual Agents": ["individualagent"],
    "Corporate Agents - Banks": ["corporateagentsbank", "corporateagentbank"],
    "Corporate Agents - Others": ["corporateagentsother", "corporateagentother"],
    "Brokers": ["broker"],
    "Direct Business": ["directbusiness"],
}

# spellings of a line of business in a group header, matched whole
SEGMENT_SPELLINGS = {
    "Health": ["health", "health insurance"],
    "Personal Accident": ["personal accident", "pa"],
    "Travel": ["travel", "travel insurance"],
}

# schedule tag -> pattern of its page
FORM_PATTERNS = {
    "NL-1": r"FORM\s+NL-1-B-RA",
    "NL-2": r"FORM\s+NL-2-B-PL",
    "NL-3": r"FORM\s+NL-3-B-BS",
    "NL-4": r"FORM\s+NL-4(?!\d)",
    "NL-5": r"FORM\s+NL-5",
    "NL-6": r"FORM\s+NL-6",
    "NL-7": r"FORM\s+NL-7",
    "NL-10": r"FORM\s+NL-10",
    "NL-12": r"FORM\s+NL-12",
    "NL-20": r"FORM\s+NL-20",
    "NL-29": r"(?m)^\s*(?:FORM\s+)?NL-29(?!\d)",
    "NL-31": r"FORM\s+NL-31",
    "NL-33": r"FORM\s+NL-33",
    "NL-34": r"FORM\s+NL-34",
    "NL-36": r"FORM\s+NL-36",
    "NL-37": r"FORM\s+NL-37",
    "NL-39": r"FORM\s+NL-39",
    "NL-41": r"FORM\s+NL-41",
}

# fixed values: wordings of period headers
CUMULATIVE_WORDS = ["up to", "upto", "period ended", "year ended"]
QUARTER_WORDS = ["for the quarter", "for the corresponding quarter"]
PERIOD_WORDS = ["for the period", "for the corresponding period"]
SNAPSHOT_WORDS = ["as at", "as on"]
UPTO_WORDS = ["up to the quarter", "up to the corresponding quarter", "up to the period", "up to the corresponding period",
              "upto the quarter", "upto the corresponding quarter", "upto the period", "upto the corresponding period"]
YEAR_WORDS = ["for the year", "for the corresponding year", "up to the year", "up to the corresponding year", "upto the year",
              "upto the corresponding year"]
LAST_YEAR_WORDS = ["previous", "corresponding"]

# fixed values: row labels
IT_WORDS = ["information technology", "it equip", "computer", "software", "website", "intangible"]
NOT_IT_WORDS = ["goodwill", "work in progress", "total", "previous"]
OFFICE_WORDS = {
    "opening": ["office at the beginning", "offices at the beginning"],
    "closing": ["branches at the end", "offices at the end"]}
ON_ROLL_WORDS = ["on roll", "on-roll", "onroll"]
CLAIM_STEP_WORDS = {
    "start": ["o/s at the begin"], "reported": ["reported during"], "settled": ["settled during"],
    "repudiated": ["repudiated during"], "end": ["o/s at end"]}
CLAIM_AMOUNT_WORDS = ["amount in", "amt of claim", "rs in lakh", "rs. in lakh", "rs.in lakh"]
CLAIM_COUNT_WORDS = ["no of claims", "no. of claims", "no.of claims", "nos of claim", "no of claim"]
AGEING_WORDS = ["less than 3", "3 month to 6", "3 months to 6", "6 month to 1", "6 months to 1", "1 year and above", "1 period and above"]

# fixed values: line of the income statement -> schedule, label variants in order (a variant is a list of fragments)
INCOME_LINES = {
    "gross direct premium": ("NL-4", [["Gross Direct Premium"], ["Gross Direct"]]),
    "reinsurance accepted": ("NL-4", [["Premium on reinsurance accepted"], ["reinsurance accepted"]]),
    "net written premium": ("NL-4", [["Net Written Premium"], ["Net Written"]]),
    "earned premium": ("NL-4", [["Net Earned Premium"], ["Total Premium Earned (Net)"], ["Premium Earned (Net)"], ["Net Earned"]]),
    "claims": ("NL-1", [["Claims Incurred"]]),
    "commission": ("NL-1", [["Commission"]]),
    "opex": ("NL-1", [["Operating Expenses related to Insurance Business"]]),
    "policyholders' interest": ("NL-1", [["Interest,", "Rent"]]),
    "policyholders' sale": ("NL-1", [["sale", "investments"]]),
    "gross commission": ("NL-6", [["Gross Commission"], ["Direct Commission"]]),
    "commission and remuneration": ("NL-6", [["Commission & Remuneration"]]),
    "rewards": ("NL-6", [["Rewards"]]),
    "distribution fees": ("NL-6", [["Distribution fees"]]),
    "accepted commission": ("NL-6", [["Commission on Re-insurance Accepted"], ["Re-insurance Accepted"], ["Reinsurance Accepted"]]),
    "gst": ("NL-7", [["Goods and Service"]]),
    "in house cost": ("NL-7", [["In House Claim Processing"]]),
    "shareholders' interest": ("NL-2", [["Interest,", "Rent"]]),
    "shareholders' profit on sale": ("NL-2", [["Profit on sale", "investments"], ["Profit", "sale/redemption", "investments"]]),
    "shareholders' loss on sale": ("NL-2", [["Loss on sale", "investments"], ["Loss", "sale/redemption", "investments"]]),
    "shareholders' amortization": ("NL-2", [["Amortization of Premium"]]),
    "pbt": ("NL-2", [["Before Tax"]]),
    "pat": ("NL-2", [["after tax"]]),
    "total b": ("NL-2", [["TOTAL", "(B)"]]),
    "ceo": ("NL-2", [["remuneration of MD"]]),
}
# fixed values: the same lines where a schedule is text without a grid
INCOME_TEXT_LINES = {
    "gross direct premium": ("NL-4", [["Gross Direct Premium"]]),
    "reinsurance accepted": ("NL-4", [["reinsurance accepted"]]),
    "net written premium": ("NL-4", [["Net Written Premium"]]),
    "earned premium": ("NL-4", [["Earned Premium"]]),
    "claims": ("NL-1", [["Claims Incurred"]]),
    "commission": ("NL-1", [["Commission"]]),
    "opex": ("NL-1", [["Operating Expenses related to Insurance Business"]]),
    "policyholders' interest": ("NL-1", [["Interest, Dividend", "Gross"]]),
    "policyholders' sale": ("NL-1", [["Profit / Loss on Sale"]]),
    "gross commission": ("NL-6", [["Gross Commission"], ["Direct Commission"]]),
    "accepted commission": ("NL-6", [["Commission on Re-insurance Accepted"], ["Re-insurance Accepted"], ["Reinsurance Accepted"]]),
    "gst": ("NL-7", [["Goods and Service"]]),
    "in house cost": ("NL-7", [["In House Claim Processing"]]),
    "shareholders' interest": ("NL-2", [["Interest and Dividend"]]),
    "shareholders' profit on sale": ("NL-2", [["Sale of Investments"]]),
    "shareholders' amortization": ("NL-2", [["Amortis", "Premium"], ["Amortiz", "Premium"]]),
    "pbt": ("NL-2", [["Before Tax"]]),
    "pat": ("NL-2", [["after tax"]]),
    "total b": ("NL-2", [["TOTAL", "(B)"]]),
    "contribution": ("NL-2", [["Contribution to Policyholders"], ["towards excess", "management"], ["excess eom"], ["towards excess", "eom"]]),
    "ceo": ("NL-2", [["remuneration of MD"]]),
}
INCOME_TEXT_EXCLUDED = {"pbt": ["Exceptional"]}
COMMISSION_PARTS = ["commission and remuneration", "rewards", "distribution fees"]
INVESTMENT_LINES = ["policyholders' interest", "policyholders' sale", "shareholders' interest", "shareholders' profit on sale",
                    "shareholders' loss on sale", "shareholders' amortization"]

# fixed values: ratings and maturities of a portfolio
RATINGS = ["Sovereign", "AAA rated", "AA or better", "Rated below AA but above A", "Rated below A"]
MATURITIES = ["Up to 1 year", "More than 1 year and upto 3 years", "More than 3 years and upto 7 years", "More than 7 years and upto 10 years",
              "Above 10 years"]


def dimension_rows(groups: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(member, group) rows of a mapping above, in its order."""
    return [(member, group) for group, members in groups.items() for member in members]
