"""Vocabularies and thresholds that results depend on."""

# Life-saving rules, in display order, and the order that settles ties (rarest first).
RULES = ["confined_space", "working_at_height", "energy_isolation", "hot_work", "safe_mechanical_lifting", "driving", "line_of_fire"]
TIE_ORDER = ["confined_space", "energy_isolation", "safe_mechanical_lifting", "hot_work", "driving", "working_at_height", "line_of_fire"]

# Gates that mark an absent barrier.
BARRIERS = ["energy_isolation_absent", "gas_test_absent", "permit_absent", "fall_protection_absent", "fire_watch_absent", "standby_absent", "atmosphere_unmonitored"]

# Gate names in the order in which they are evaluated.
GATES = [
    "min_length", "negation", "language", "confidence", "drill", "near_dup", "long_input", "well_control_watch", "chunked_low_score", "severity_watch",
    "energy_isolation_absent", "gas_test_absent", "permit_absent", "verdict_stability", "fall_protection_absent", "fire_watch_absent", "standby_absent", "atmosphere_unmonitored",
]

# Short safety codes that may stand alone.
SHORT_CODES = ["LOTO", "PTW", "H2S", "BOP", "WOC", "GGS", "EPS", "PPE", "ESD", "PSV", "TBT", "JSA", "N2", "O2", "LEL", "WAH", "MOC", "ERP"]

# Outcome patterns that masking replaces, several words before single ones.
MASK_TOKEN = "[OUTCOME]"
OUTCOMES = [
    r"\bcrush\s+syndrome\b", r"\b(?:loss\s+of|lost)\s+(?:\w+\s+){0,2}eyes?\b", r"\b(?:first|second|third|1st|2nd|3rd)[ -]degree\s+burns?\b",
    r"\bintensive\s+care(?:\s+unit)?\b", r"\btrauma\s+(?:center|centre)\b", r"\blife[ -]?flight\b",
    r"\bamputat\w*", r"\bfractur\w*", r"\bhospital\w*", r"\bkill\w*", r"\bfatal\w*", r"\bdeaths?\b", r"\bdied\b", r"\bsever(?:e|ely|ed|ing|s)?\b",
    r"\bunconscious\w*", r"\bunresponsive\w*", r"\bresuscitat\w*", r"\bparaly\w*", r"\bcoma\w*", r"\bicu\b", r"\bairlift\w*", r"\bmedevac\w*",
    r"\bsurg(?:er(?:y|ies)|ical)\b", r"\bsuccumb\w*", r"\binjur\w*",
]

# Keyword patterns of each rule.
KEYWORDS = {
    "confined_space": [r"\bconfined space\b", r"\bmanhole\b", r"\btank entry\b", r"\bvessel entry\b", r"\benter(?:ed|ing) (?:the |a )?(?:tank|vessel|silo|vault|pit|bin|hopper)\b", r"\binside (?:the |a )?(?:tank|vessel|silo)\b"],
    "energy_isolation": [r"\block\s?out\b", r"\btag\s?out\b", r"\blockout\b", r"\btagout\b", r"\benergized\b", r"\bde-?energiz", r"\bstored energy\b", r"\barc flash\b", r"\bunexpectedly (?:started|activated|energized)"],
    "hot_work": [r"\bhot work\b", r"\bweld", r"\btorch\b", r"\bgrind", r"\bcutting (?:torch|metal|steel)", r"\bspark"],
    "safe_mechanical_lifting": [r"\bcrane\b", r"\brigging\b", r"\bhoist", r"\bsuspended load\b", r"\boverhead load\b", r"\bsling\b", r"\bdropped load\b"],
    "driving": [r"\bfork\s?lift\b", r"\bskid steer\b"],
    "line_of_fire": [r"\bstruck by\b", r"\bcaught (?:in|between)\b", r"\bcrushed\b", r"\bpinch", r"\bran over\b"],
}

# Well-control words.
WELL_CONTROL = [
    r"\bblowout\b", r"\bblow-out\b", r"\bblowout preventer\b", r"\bwell control\b", r"\bwell-control\b", r"\bbop\b", r"\bworkover\b", r"\bchristmas tree\b",
    r"\bh2s\b", r"\bhydrogen sul[fp]hide\b", r"\bgas migration\b", r"\blost circulation\b", r"\bsnubbing\b", r"\bcoiled tubing\b", r"\bwellhead\b",
]

# Code prefixes that count as positive, by era; the era changes on this day.
ERA_BOUNDARY = "2024-01-01"
POSITIVE_PREFIXES = {"v1": ["31", "32", "43", "44", "45", "51", "62", "63", "64", "65"], "v2": ["31", "32", "41", "51", "63", "64", "65", "66"]}

# Negation gate.
NEGATION_CUES = ["near miss", "did not", "was not", "were not", "didn't", "wasn't", "weren't", "prevented", "avoided", "without", "never", "none", "uninjured", "no", "not"]
COUNTERFACTUALS = ["could have", "would have", "might have", "narrowly", "almost", "nearly", "luckily", "fortunately"]
OUTCOME_STEMS = ["amputat", "fractur", "hospital", "kill", "fatal", "death", "died", "unconscious", "unresponsive", "resuscitat", "paraly", "coma", "icu", "airlift", "medevac", "surg", "succumb", "injur", "harm", "hurt", "casualt", "damage"]
SEVER_TOKENS = ["sever", "severe", "severely", "severed", "severs", "severing"]
MECHANISM_TOKENS = ["blast", "explosion", "explode", "exploded", "burst", "collapse", "collapsed", "electrocuted", "electrocution", "engulfed", "crushed"]

# Drills as events.
DRILL = (
    r"\b(?:mock drill|fire drill|evacuation drill|emergency drill|safety drill|training drill|well[- ]control drill|bop drill|trip drill|tabletop|simulated|simulation"
    r"|rescue practice|mock exercise|training exercise|emergency exercise|evacuation exercise|training scenario|(?:planned|scheduled)\s+(?:drill|exercise|simulation))\b"
)

# Absence cues, the controls that they may stand near, and direct signs of an absent control.
ABSENCE = (
    r"\b(?:no\s+one\s+was\s+assigned|nobody\s+was\s+posted\s+as|the\s+atmosphere\s+was\s+unchecked|was\s+not\s+tested\s+for|no\s+one|nobody|not|no|none|without|absent|never"
    r"|omitted|missed|skipped|missing|left|gone|withdrew|unverified|untested|unchecked|unconfirmed|unattended|unavailable|unlatched|failed|forgotten|lacked|lacking)\b"
)
CONTROLS = {
    "energy_isolation_absent": r"\b(?:loto|lock[\s/-]?out(?:[\s/-]?tag[\s/-]?out)?|tag[\s/-]?out|isolation(?:s)?|isolat(?:e|ed|es|ing)|de-?energi[sz]\w*|energi[sz]\w*|prov(?:e|ed|ing)\s+dead|test(?:ed|ing)?\s+dead|absence\s+of\s+voltage|zero[\s-]+voltage)\b",
    "gas_test_absent": r"\b(?:gas test\w*|gas detect\w*|atmospher\w* test\w*|air test\w*|o2 test\w*|oxygen test\w*|gas reading\w*|tested for gas|gas reading taken|atmospher\w*\s+was\s+not\s+tested|atmospher\w*\s+was\s+unchecked|atmospher\w*\s+unchecked)\b",
    "permit_absent": r"\b(?:permit to (?:work|enter)|work permit|ptw|entry permit|hot[\s-]?work permit|confined space permit|cold work permit|permit system)\b",
    "fall_protection_absent": r"\b(?:anchor(?:age)?(?:\s+point)?s?|full[\s-]?body harness(?:es)?|harness(?:es)?|double[\s-]?lanyards?|lanyards?|rope grabs?|fall[\s-]?arrest(?:\s+devices?)?|lifelines?|tied[\s-]?off|tie[\s-]?off)\b",
    "fire_watch_absent": r"\bfire ?watch(?:er|ers|ing|man|men)?\b",
    "standby_absent": r"\b(?:stand ?by|attendant|hole watch(?:es)?|bottle watch|safety watch|banksman|spotter|lookout|sentinel|unattended)\b",
    "atmosphere_unmonitored": r"\b(?:monitor\w*|purg\w*|sweep\w*)\b",
}
DIRECT = {
    "atmosphere_unmonitored": r"\b(?:(?:nitrogen|n2|inert)\s+(?:gas\s+)?(?:purg\w*|sweep\w*)|(?:purg\w*|sweep\w*)\b.{0,24}?\b(?:in[\s-]?progress|ongoing|underway))\b",
    "permit_absent": r"\b(?:began|started|commenced|proceeded|carried\s+out)\b.{0,48}?\bbefore\b.{0,24}?\b(?:permit\s+to\s+work|ptw)\b.{0,24}?\b(?:signed|approved|authori[sz]ed|issued)\b",
    "fall_protection_absent": r"\b(?:started|began|commenced|proceeded)\b.{0,48}?\bbefore\b.{0,24}?\b(?:anyone|anybody|someone)\s+confirmed\b.{0,24}?\b(?:anchor(?:age)?(?:\s+point)?|tie[\s-]?off)\b",
}
# Of each barrier's patterns, what a text must hold (in lower case) for any of them to match.
NEEDED = {
    "energy_isolation_absent": ["loto", "lock", "tag", "isolat", "energi", "dead", "voltage"], "gas_test_absent": ["gas", "atmospher", "air test", "o2 test", "oxygen test"],
    "permit_absent": ["permit", "ptw"], "fall_protection_absent": ["anchor", "harness", "lanyard", "rope grab", "arrest", "lifeline", "tied", "tie off", "tie-off", "tieoff"],
    "fire_watch_absent": ["watch"], "standby_absent": ["stand", "attend", "watch", "banksman", "spotter", "lookout", "sentinel"], "atmosphere_unmonitored": ["monitor", "purg", "sweep"],
}
PURGE_OVER = r"\b(?:complet\w*|finish\w*|stopp\w*|halt\w*|abort\w*|cancel\w*|suspend\w*|before|prior|preced\w*)\b"

# Thresholds.
FLAG, GRAY_LOW, GRAY_HIGH, NEAR_DUP, NON_ASCII, LONG_WORDS, LONG_CHARS, MIN_LENGTH = 0.5647, 0.40, 0.60, 0.91, 0.15, 120, 10_000, 20
NEGATION_WINDOW, BARRIER_WINDOW, STABLE, DENSE = 5, 3, 0.75, 0.40
UNSPECIFIED = "(unspecified)"

# Words for a missing facet; registers of synthetic rows; phrases that generated text is known by.
MISSING_WORDS = ["(unspecified)", "(live paste)", "Site not provided", "Activity not provided", "साइट उपलब्ध नहीं", "गतिविधि उपलब्ध नहीं"]
REGISTERS = ["near_miss", "drill", "ua_uc_observation"]
MACHINE_PHRASES = ["furthermore", "moreover", "in conclusion", "it is important to note", "underscores", "highlighting the importance"]

# Anomalies of aviation reports that carry high energy or harm, by the start of their name.
ANOMALY_PREFIXES = [
    "Conflict", "Ground Event / Encounter", "Ground Excursion", "Ground Incursion", "Inflight Event / Encounter",
    "Flight Deck / Cabin / Aircraft Event Smoke / Fire / Fumes", "Flight Deck / Cabin / Aircraft Event Illness / Injury",
]

# Vector arithmetic in gate details.
VECTOR_TALK = [r"cosine\s*=\s*[\d.]+(?:\s+with\s+index\s+row\s+\S+)?(?:\s*\(?\s*>=?\s*[\d.]+\s*\))?", r"max\s+cosine\s*=\s*[\d.]+", r"index\s+row\s+\S+"]

# Cues of a sudden release, and the patterns that are evidence of a rule.
RELEASE = [
    r"\bruptur(?:e|ed|ing|es)\b", r"\bexplod(?:e|ed|ing|es)\b", r"\bexplosions?\b", r"\bblast(?:s|ed|ing)?\b", r"\bburst(?:s|ed|ing)?\b", r"\bprojectiles?\b",
    r"\bflying debris\b", r"\bflying fragments\b", r"\bthrown fragments\b", r"\breleased under pressure\b", r"\bpressure release\b",
]
EVIDENCE = {
    "confined_space": [r"\bconfined space\b", r"\bmanhole\b", r"\btank entry\b", r"\bvessel entry\b", r"\binside (?:the |a )?(?:tank|vessel|silo)\b", r"\bgas test\b", r"\bventilat"],
    "energy_isolation": [r"\bloto\b", r"\block\s?out\b", r"\btag\s?out\b", r"\benergiz", r"\bde-?energiz", r"\bstored energy\b", r"\bisolat", r"\barc flash\b"],
    "hot_work": [r"\bhot work\b", r"\bweld", r"\bgrind", r"\btorch\b", r"\bspark", r"\bcutting\b"],
    "safe_mechanical_lifting": [r"\bcrane\b", r"\blift", r"\brigging\b", r"\bhoist", r"\bsling\b", r"\bsuspended load\b", r"\boverhead load\b"],
    "driving": [r"\bvehicle\b", r"\bdriv", r"\bfork\s?lift\b", r"\bspeed", r"\bseat belt\b", r"\brevers", r"\broad\b", r"\bjourney\b"],
    "line_of_fire": [
        r"\b(?:drop(?:ped|ping)?|fell|falling)\b", r"\bstruck\b", r"\bcaught\b", r"\btrap(?:ped|ping)?\b", r"\bcrush", r"\bpinch", r"\bline of fire\b", r"\bsuspended load\b", r"\boverhead\b",
        r"\b(?:near|above|below|beneath|toward|onto)\b.{0,45}\b(?:worker|crew|person|roughneck|operator|leg|hand)\b", *RELEASE,
    ],
    "working_at_height": [r"\bheight\b", r"\bscaffold", r"\bladder\b", r"\bharness\b", r"\bfall arrest\b", r"\broof\b", r"\belevated\b", r"\bderrick\b"],
}

# Cues whose places are shown where a scorer names none; the order of a scorer's rule outputs.
SPAN_CUES = KEYWORDS | {"energy_isolation": [*KEYWORDS["energy_isolation"], r"\bloto\b"], "line_of_fire": [*KEYWORDS["line_of_fire"], *RELEASE]}
RULE_HEADS = ["line_of_fire", "working_at_height", "driving", "energy_isolation", "hot_work", "safe_mechanical_lifting", "confined_space"]

# Words that make no span of their own; what an absent barrier means in plain words.
SPAN_STOPWORDS = (
    "the a an and or of to in on at by was were is it its with without no not during per this that from for all next be been as are had has have he she his her their our we they hrs am pm"
).split()
BARRIER_MEANING = {
    "energy_isolation_absent": "lock-out/tag-out or isolation", "gas_test_absent": "a gas test before entry", "permit_absent": "a permit to work", "fire_watch_absent": "a fire watch",
    "standby_absent": "a standby person", "atmosphere_unmonitored": "atmosphere monitoring", "fall_protection_absent": "fall protection or a harness",
}

# How a report names its place: a labelled start, a phrase behind a preposition, and words of places.
PLACE_LABEL = r"^\s*(?:site|location|field|installation|plant)\s*[:\-–—]\s*([^.\n]{2,80})"
PLACE_PHRASE = r"\b(?:at|near|inside|within)\s+(?:the\s+)?([^,.;\n]{2,60})"
PLACE_WORD = r"\b(?:site|area|field|plant|station|terminal|yard|road|rig|well|ggs|gcs|ctf|eps|workshop|warehouse|stores|facility|installation|platform)\b"

# Rules of event codes by the first two digits, before the era's boundary and from it on.
CODE_RULES = {
    "v1": {
        "62": "line_of_fire", "63": "line_of_fire", "64": "line_of_fire", "65": "line_of_fire", "43": "working_at_height", "44": "working_at_height", "45": "working_at_height",
        "20": "driving", "21": "driving", "22": "driving", "23": "driving", "24": "driving", "25": "driving", "26": "driving", "27": "driving",
        "31": "hot_work", "32": "hot_work", "51": "energy_isolation", "56": "confined_space",
    },
    "v2": {
        "63": "line_of_fire", "64": "line_of_fire", "65": "line_of_fire", "66": "line_of_fire", "41": "working_at_height",
        "20": "driving", "21": "driving", "22": "driving", "23": "driving", "24": "driving", "25": "driving", "26": "driving", "27": "driving",
        "31": "hot_work", "32": "hot_work", "51": "energy_isolation", "56": "confined_space",
    },
}

# Talk about a task in place of an explanation.
META_TALK = r"\b(the user|i need to|i should|let me|my task|the instruction|the rules|i will|step by step|first, i)\b"
