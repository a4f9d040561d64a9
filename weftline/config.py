"""Thresholds, weights and lists of the story model; all may be overridden."""

from __future__ import annotations

from dataclasses import dataclass, field

# Weights of the hybrid score and its bonuses.
WEIGHTS = {"embedding": 0.45, "entities": 0.12, "title": 0.25, "time": 0.10, "keyphrases": 0.0, "geography": 0.08}
BONUSES = {"artifacts": 0.06, "quotes": 0.05, "outlet": 0.04, "slug": 0.08}

# Entities too common to tell stories apart.
STOP_ENTITIES = (
    "US-TRUMP", "US-BIDEN", "LOC-USA", "ORG-WHITE-HOUSE", "ORG-DEM", "ORG-GOP", "ORG-CONGRESS", "ORG-SENATE",
    "ORG-HOUSE", "ORG-SUPREME-COURT", "ORG-DOJ", "ORG-FBI", "LOC-WASHINGTON",
)

# Domains of wire services.
WIRE_DOMAINS = ("ap.org", "apnews.com", "reuters.com", "afp.com", "bloomberg.com", "upi.com", "marketwatch.com")

# Parameters that only track where a reader came from.
TRACKING_PARAMETERS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "msclkid", "ref",
    "referrer", "source", "_ga", "_gl", "mc_cid", "mc_eid",
)

# Stems of event words and their common root; which roots say much; tokens to leave out.
EVENT_ROOTS = {
    "seiz": "SEIZE", "seizur": "SEIZE", "confirm": "CONFIRM", "nomin": "NOMINATE", "indict": "INDICT", "arrest": "ARREST",
    "announc": "ANNOUNCE", "investig": "INVESTIGATE", "appoint": "APPOINT", "resign": "RESIGN", "fire": "FIRE",
    "ban": "BAN", "order": "ORDER", "sign": "SIGN",
}
HIGH_SIGNAL_EVENTS = ("SEIZE", "INDICT", "ARREST", "RESIGN", "APPOINT", "INVESTIGATE", "FIRE", "CONFIRM", "NOMINATE", "ANNOUNCE")
STOP_TOKENS = ("TRUMP", "WHITE", "HOUSE", "SAYS", "SAY", "NEWS", "UPDATE", "REPORT", "BREAKING", "LATEST", "NEW")
ACRONYMS = ("DOJ", "FBI", "DHS", "CIA", "NSA", "EPA", "IRS", "GOP", "DNC", "USA", "NATO")

# Event words and the form that slugs keep.
EVENT_WORDS = {
    "CONFIRMED": "CONFIRM", "CONFIRMATION": "CONFIRM", "CONFIRMING": "CONFIRM", "HEARING": "HEAR", "HEARINGS": "HEAR",
    "NOMINATION": "NOMINATE", "NOMINATED": "NOMINATE", "NOMINATIONS": "NOMINATE", "INVESTIGATION": "INVESTIGATE",
    "INVESTIGATING": "INVESTIGATE", "INVESTIGATED": "INVESTIGATE", "ANNOUNCEMENT": "ANNOUNCE", "ANNOUNCED": "ANNOUNCE",
    "ANNOUNCING": "ANNOUNCE", "APPOINTMENT": "APPOINT", "APPOINTED": "APPOINT", "INDICTMENT": "INDICT", "INDICTED": "INDICT",
    "ARRESTED": "ARREST", "RESIGNATION": "RESIGN", "RESIGNED": "RESIGN",
}

# Patterns of relevance, and of what is local or opinion.
FEDERAL = (
    r"\bcongress\b", r"\bsenate\b", r"\bhouse (of representatives|judiciary|appropriations|oversight|ways and means)\b",
    r"\bwhite house\b", r"\bsupreme court\b|\bscotus\b", r"\bexecutive order\b",
    r"\bdepartment of (justice|defense|state|treasury|homeland security)\b", r"\b(doj|dod|dhs|fbi|cia|nsa|ice|cbp|atf|dea)\b",
    r"\bfederal\b", r"\bfederal court\b", r"\b(5th|9th|dc) circuit\b",
)
BOOST = (r"\btrump\b", r"\bmaga\b", r"mar-a-lago")
LOCAL = (
    r"\bcity council\b", r"\bschool board\b", r"\bborough\b", r"\bcounty (commission|board)\b", r"\bmayor(al)?\b",
    r"\bgubernatorial\b", r"\bstate legislature\b", r"\btown meeting\b",
)
PATH_GOOD = r"(/us-news/|/politics/|/elections/|/white-house/|/congress/)"
PATH_BAD = r"(/uk-news/|/local/|/opinion/|/live/|/podcast/|/video/|/culture/)"
OPINION_PATH = r"/(opinion|editorial|commentary|analysis|op-ed|blogs?)/"
OPINION_TITLE = r"^(opinion|editorial|commentary|analysis):"
ROUNDUP = r"at a glance|live updates|live blog|what we know|latest updates|morning briefing|evening briefing|roundup|what happened"

# Words of a category, first match wins.
CATEGORIES = (
    ("immigration_border", ("immigration", "border", "asylum", "deportation")),
    ("environment_energy", ("climate", "energy", "environment", "oil", "gas", "drilling")),
    ("health_care", ("health", "medicare", "medicaid", "hospital")),
    ("natsec_foreign", ("defense", "military", "foreign", "security", "nato", "sanctions")),
    ("economy_jobs_taxes", ("trade", "tariff", "tax", "economy", "jobs", "inflation")),
    ("education", ("education", "school", "student")),
    ("justice_civil_rights_voting", ("court", "judicial", "civil rights", "voting", "justice")),
    ("technology_data_privacy", ("technology", "data", "privacy", "ai", "cyber")),
    ("infra_housing_transport", ("infrastructure", "housing", "transport", "highway", "bridge")),
)
OTHER_CATEGORY = "gov_ops_workforce"
# Points of words that raise the impact score.
IMPACT = ((("emergency",), 20), (("national security",), 15), (("immediately",), 10), (("suspend",), 15), (("terminate",), 15), (("billion", "million"), 10))

# Headlines that alarm, that only seem to be good news, and that are.
ALARMED = (
    "insurrection", "coup", "fascis", "authoritarian", r"martial\s+law", r"mass\s+deportation", r"constitutional\s+crisis", "impeach", "indicted?", "arrested", "raided?", r"charged\s+with",
    r"emergency\s+powers?", r"suspend(ed|s)?\s+(rights|constitution|habeas)", "dictator|dictatorship",
)
URGENT = "breaking|urgent|emergency|crisis"
NEGATED = (
    r"\bblock(?:ed|s|ing)?\s+(?:\w+\s+){0,3}(aid|relief|funding|assistance|access|investigation|inquiry|oversight|probe|subpoena|testimony)\b",
    r"\bstop(?:ped|s|ping)?\s+(?:\w+\s+){0,3}(aid|relief|funding|assistance|access|investigation|inquiry|oversight|probe|subpoena|testimony)\b",
    r"\boverturned\s+(?:\w+\s+){0,2}(protection|rights|ruling|decision)\b", r"\bstruck\s+down\s+(?:\w+\s+){0,2}(protection|rights|law)\b",
)
CREDIT = (r"victory\s+for", r"wins?\s+(case|suit|ruling|appeal)", r"court\s+rules?\s+against", "blocked", "stopped", "defeated", "overturned", r"struck\s+down", "dismissed", "acquitted", "exonerated", "protected", "restored")
# Words of feed topics and the pool that they lead to, first match wins.
POOLS = (("investigations", ("investigation", "corruption", "accountability", "watchdog")), ("policy", ("policy", "legislation", "congress", "analysis")))

# Places in the order in which they are looked for.
COUNTRIES = (
    "united states", "usa", "china", "russia", "ukraine", "israel", "iran", "north korea", "south korea", "japan", "germany", "france", "united kingdom", "uk", "canada", "mexico", "brazil", "india",
    "pakistan", "syria", "iraq", "afghanistan", "gaza", "palestine",
)
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE", "florida": "FL", "georgia": "GA", "hawaii": "HI", "idaho": "ID",
    "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD", "massachusetts": "MA", "michigan": "MI", "minnesota": "MN",
    "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM", "new york": "NY", "north carolina": "NC",
    "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT",
    "vermont": "VT", "virginia": "VA", "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY",
}
CITIES = (
    "new york", "los angeles", "chicago", "houston", "phoenix", "philadelphia", "san antonio", "san diego", "dallas", "san jose", "austin", "jacksonville", "fort worth", "columbus", "charlotte", "san francisco",
    "indianapolis", "seattle", "denver", "washington", "boston", "detroit", "nashville", "memphis", "portland", "las vegas", "baltimore", "milwaukee", "atlanta", "miami", "oakland", "minneapolis", "tampa", "new orleans",
)

# Patterns of entity ids with a wrong prefix, that say little, and that are programs rather than events.
WRONG_PREFIX = r"^US-(PETRO|MACHADO|ROBISON|KHAN|ORBAN|MADURO|XI|ERDOGAN|STARMER|FARAGE|TEDROS|RAE|LOPEZ|AL-SHARA|BUKELE)"
GENERIC_ENTITY = r"^(EVT-ELECTION|EVT-ELECTIONS|EVT-CAMPAIGN|EVT-PRIMARY|EVT-CONGRESSIONAL|EVT-GOVERNORS|EVT-SPECIAL-ELECTION|EVT-MIDTERMS|EVT-2026|EVT-2028|ORG-HOUSE|ORG-ADMINISTRATION|EVT-CULTURE-WARS)"
PROGRAM_ENTITY = r"^EVT-(SNAP|ACA|H1B|GLP1|TYLENOL|CHIP-EXPORTS|ASYLUM|IMMIGRATION|TARIFFS?|ECONOMY|FREE-SPEECH|TRANS-IDENTITY)"
LOW_VALUE = (r"^US-[A-Z]+-[A-Z]+$", r"^EVT-[A-Z]+-[A-Z]+-[A-Z]+", r"^ORG-[A-Z]{2,3}$")
# Slugs too common to tell stories apart.
GENERIC_SLUGS = ("us-politics", "immigration", "foreign-policy", "breaking", "news", "analysis", "politics", "world")
# Prefixes of entity codes that names are shown without.
CODE_PREFIXES = ("US-", "ORG-", "INTL-", "STATE-", "GOV-")


@dataclass(frozen=True)
class Thresholds:
    """Gates of the clustering decision; embedding gates are on the scale of the similarity they are given."""

    wire: float = 0.68
    opinion: float = 0.76
    policy: float = 0.72
    default: float = 0.70
    min_embedding: float = 0.60
    min_title: float = 0.50
    very_high_embedding: float = 0.90
    token_embedding: float = 0.85
    overlap_count: int = 2
    overlap_share: float = 0.60
    reopen: float = 0.80
    margin: float = 0.04
    tier_a: float = 0.90
    tier_a_single: float = 0.92
    tier_a_hours: float = 48.0
    tier_b: float = 0.88
    tier_b_hours: float = 72.0
    near_miss: float = 0.85
    title_bypass: float = 0.905
    tier_b_bypass: bool = False
    decay_hours: float = 72.0
    shadow: tuple[float, ...] = field(default=(0.86, 0.87, 0.88, 0.89))

# Words of headlines that are too common to tell the stories of one batch apart, and short places that do.
BATCH_COMMON = (
    "trump", "biden", "netanyahu", "america", "congress", "supreme", "federal", "national", "president", "administration", "judge", "court", "says", "amid", "after", "meeting",
)
SHORT_PLACES = ("iran", "gaza", "iraq", "cuba", "nato", "un")
