"""Default lexicons. Everything here is a parameter elsewhere; corpora bring their own tables."""

from __future__ import annotations

# fixed values: event types and the keyword patterns that mark them
EVENT_PATTERNS = {
    "KILL": (r"\b(?:kill|killed|slay|slew|slain|struck?\s+down|struck?\s+dead|smote|smitten|slaughter|beheaded|beheading|decapitated|murder|murdered)\b",),
    "COMMAND": (r"\b(?:command|commanded|led|ordered|instructed|directed|sent|dispatch|deputed)\b",),
    "BATTLE": (r"\b(?:battle|fought|fought\s+(?:with|against)|clash|combat|war|duel|skirmish|battle\s+(?:between|of)|fought\s+(?:in|at))\b",),
    "VOW": (r"\b(?:vow|vowed|vow(?:ing|ed)|swore|sworn|swear|oath|promise|promised)\b",),
    "CURSE": (r"\b(?:curse|cursed|curse\s+(?:upon|on)|cursing|accursed|doomed|condemned|imprecation)\b",),
    "BOON": (r"\b(?:boon|granted\s+a\s+boon|boon\s+(?:from|of)|granted|granted\s+(?:to|him)|favour|favor|gift|bestowed)\b",),
    "DEATH": (r"\b(?:died|death|perish|perished|fallen|fell|expire|expired|breathed\s+(?:his|her)\s+last|passed\s+away|succumb|succumbed)\b",),
    "CORONATION": (r"\b(?:crowned|coronation|anointed|installed\s+as\s+king|made\s+king|enthroned|ascended\s+(?:the\s+)?throne)\b",),
    "ENGAGED_IN_BATTLE": (
        r"\b(?:engaged\s+(?:in\s+)?(?:battle|combat|fight)|encountered\s+(?:in\s+)?battle|met\s+(?:in\s+)?battle|joined\s+battle\s+with|stood\s+against|opposed|confronted)\b",
        r"\b(?:advanced\s+against|assailed|attacked|surged\s+against)\b",
    ),
    "DEFEATED": (r"\b(?:defeated|overcame|vanquished|routed|conquered|subdued|overpowered|worsted|broke\s+the\s+ranks\s+of)\b",),
    "PROTECTED": (r"\b(?:protected|defended|shielded|guarded|covered\s+the\s+retreat\s+of|supported|reinforced|held\s+firm\s+for)\b",),
    "PURSUED": (r"\b(?:pursued|chased|followed|hunted|tracked)\b",),
    "RESCUED": (r"\b(?:rescued|saved|delivered\s+from|liberated|freed)\b",),
    "APPOINTED_AS": (r"\b(?:appointed\s+(?:as)?|installed\s+as|made\s+(?:commander|general|minister|king)|designated\s+as)\b",),
    "ABANDONED": (r"\b(?:abandoned|left|forsook|deserted|renounced|retreated\s+before|fled\s+from|fell\s+back\s+before)\b",),
    "ATTACKED": (r"\b(?:attacked|assailed|assaulted|struck\s+at|charged\s+at|fell\s+upon|made\s+war\s+upon)\b",),
    "DEFENDED": (r"\b(?:defended|shielded|protected|held\s+the\s+line\s+against|stood\s+fast\s+against)\b",),
    "RETREATED": (r"\b(?:retreated|fell\s+back|withdrew|fled\s+from|turned\s+back\s+before)\b",),
    "SURROUNDED": (r"\b(?:surrounded|encompassed|hemmed\s+in|closed\s+in\s+upon)\b",),
    "SUPPORTED": (r"\b(?:supported|reinforced|succoured|came\s+to\s+the\s+aid\s+of|covered\s+the\s+retreat\s+of)\b",),
    "FORMED_ARRAY_AGAINST": (r"\b(?:formed\s+(?:an\s+)?array\s+against|arrayed\s+against|drew\s+up\s+against|entered\s+the\s+ranks\s+of)\b",),
}
# fixed values: by type and role, what stands before a participant, the participant, and what follows
ROLE_PATTERNS = {
    "KILL": {
        "agent": (r"\b(?:who|X)\b", r"[a-z]+(?:\s+of\s+\w+)*", r"(?:\s+kill|\s+slew)"),
        "patient": (r"(?:killed|slew|slain)\s+", r"[a-z]+(?:\s+(?:of|the)\s+\w+)*", r"(?:\s|,|\.|$)"),
    },
    "COMMAND": {
        "agent": (r"(?:, )?", r"[a-z]+(?:\s+\w+)*", r"(?:\s+commanded|\s+ordered)"),
        "patient": (r"(?:commanded|ordered)\s+", r"[a-z]+(?:\s+\w+)*", r"(?:\s+(?:to|not)\s|\s|,|\.|$)"),
    },
    "BATTLE": {
        "agent1": (r"(?:between|with)\s+", r"[a-z]+(?:\s+and\s+|,\s+)*", r"(?:\s+and|\s+,)"),
        "agent2": (r"(?:\s+and|\s+,)\s+", r"[a-z]+(?:\s+\w+)*", r"(?:\s|,|\.|$)"),
    },
    "VOW": {"agent": (r"(?:, )?", r"[a-z]+(?:\s+\w+)*", r"(?:\s+vowed|\s+swore)")},
    "BIRTH": {"agent": (r"(?:, )?", r"[a-z]+(?:\s+\w+)*", r"(?:\s+was\s+born|was\s+begotten)")},
    "CURSE": {
        "agent": (r"(?:, )?", r"[a-z]+(?:\s+\w+)*", r"(?:\s+cursed)"),
        "patient": (r"(?:cursed)\s+", r"[a-z]+(?:\s+\w+)*", r"(?:\s|,|\.|$)"),
    },
    "BOON": {
        "agent": (r"(?:, )?", r"[a-z]+(?:\s+\w+)*", r"(?:\s+granted)"),
        "recipient": (r"(?:granted)\s+(?:to\s+)?", r"[a-z]+(?:\s+\w+)*", r"(?:\s|,|\.|$)"),
    },
    "EXILE": {"agent": (r"(?:, )?", r"[a-z]+(?:\s+\w+)*", r"(?:\s+was\s+exiled|\s+was\s+banished)")},
    "DEATH": {"agent": (r"(?:, )?", r"[a-z]+(?:\s+\w+)*", r"(?:\s+died|\s+perished)")},
}
# fixed values: the pivotal types; all others are tactical (MESO)
MACRO_TYPES = ("KILL", "COMMAND", "BATTLE", "VOW", "CURSE", "BOON", "DEATH", "CORONATION")
# fixed values: sentences with one of these verbs are no events
MICRO_VERBS = (
    "said", "spoke", "replied", "answered", "told", "asked", "questioned",
    "went", "came", "arrived", "departed", "returned", "reached",
    "saw", "looked", "beheld", "witnessed", "observed",
    "thought", "knew", "understood", "remembered", "forgot",
    "stood", "sat", "lay", "arose", "rose",
)
# fixed values: cues that raise a tactical event's confidence
TACTICAL_VERBS = (
    "attack", "assail", "assault", "strike", "charged", "fell upon", "made war",
    "defend", "shield", "protect", "hold the line", "stood fast",
    "pursue", "chase", "hunt", "follow",
    "retreat", "withdrew", "fled", "fell back", "turned back",
    "surround", "hemmed in", "closed in", "arrayed", "formed array", "entered the ranks",
    "support", "reinforce", "succour", "cover the retreat",
)
# fixed values: question intents, their event types and their order when several match
INTENT_TYPES = {
    "FACT": ("KILL", "DEATH", "BATTLE", "CORONATION", "APPOINTED_AS", "CURSE"),
    "CAUSAL": ("SUPPORTED", "DEFENDED", "VOW", "COMMAND"),
    "TEMPORAL": ("DEATH", "BATTLE", "RETREATED"),
    "MULTI_HOP": ("KILL", "DEATH", "BOON", "CURSE"),
}
INTENT_PATTERNS = (
    ("CAUSAL", (r"\bwhy\b|\bbecause\b|\breason\b",)),
    ("TEMPORAL", (r"\bbefore\b|\bafter\b|\bduring\b|\bfirst\b|\blast\b",)),
    ("MULTI_HOP", (r"\bbenefit(?:ed|s)?\b", r"\bconsequence(?:s)?\b", r"\bimpact(?:ed|s)?\b", r"\bled to\b", r"\bresult(?:ed)? in\b", r"\bgained\b", r"\badvantage\b")),
    ("FACT", (r"\bwho\b|\bwhom\b|\bwhat\b|\bwhen\b",)),
)
TRIGGER_TYPES = ("KILL", "DEATH", "BATTLE")
# fixed values: pronouns that are never seeds of a question
SEED_PRONOUNS = ("i", "me", "we", "you", "he", "she", "they", "them", "him", "her", "it", "his", "hers", "their", "theirs", "your", "yours", "who", "whom")
TYPE_ORDER = ("PERSON", "GROUP", "PLACE", "TIME", "LITERAL")
# fixed values: candidate filters of arguments and of entities
ARGUMENT_PRONOUNS = ("thou", "thee", "thy", "him", "her", "they", "them", "his", "hers", "their", "who", "whom", "whose", "he", "she", "it", "we", "you", "i", "me", "my")
STOP_PHRASES = ("having", "being", "the presence", "the act of", "in order to", "which is", "that is", "as well as")
COMMON_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "from", "for", "of", "with", "by", "as", "is", "was", "are", "were", "been", "be",
    "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "can", "must", "shall",
)
PREPOSITIONS = ("the", "of", "in", "on", "at", "to", "from", "for", "by", "with")
ENTITY_PRONOUNS = ("he", "she", "it", "they", "them", "his", "her", "its", "their", "thou", "thee", "thy", "him", "whom", "whose", "hers", "i", "me", "my", "we", "us", "our", "you", "your")
NOISE_WORDS = ("one", "two", "three", "many", "some", "other", "all", "the", "a", "an", "and", "or", "but", "with", "to", "in", "on", "at", "from", "for", "by", "of", "as")
GERUNDS = ("having ", "being ", "doing ", "making ")
FUNCTION_WORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "from", "for", "of", "with", "by")
# fixed values: words whose presence in a name gives its type, in this order
TYPE_HINTS = (
    ("PERSON", ("krishna", "arjuna", "bhima", "drona", "karna", "yudhishthira", "duryodhana", "bhishma", "draupadi")),
    ("GROUP", ("pandava", "kaurava", "warrior", "army", "clan", "tribe", "race", "kingdom")),
    ("PLACE", ("kurukshetra", "india", "hastinapura", "indraprastha", "forest", "city", "kingdom", "palace", "land")),
    ("TIME", ("morning", "evening", "night", "day", "year", "age")),
)
# fixed values: names of one entity
ALIASES = {
    "arjuna": ("arjuna", "partha", "dhananjaya", "vibhatsu", "kiritin", "phalguna"),
    "bhima": ("bhima", "bhimasena", "vrikodara"),
    "yudhishthira": ("yudhishthira", "dharma"),
    "nakula": ("nakula",),
    "sahadeva": ("sahadeva",),
    "duryodhana": ("duryodhana", "suyodhana"),
    "duhsasana": ("duhsasana",),
    "krishna": ("krishna", "keshava", "vasudeva", "janardana", "madhava", "achyuta"),
    "bhishma": ("bhishma",),
    "drona": ("drona",),
    "karna": ("karna", "radheya", "vasusena"),
    "draupadi": ("draupadi", "panchali"),
    "kunti": ("kunti", "pritha"),
    "gandhari": ("gandhari",),
}
# fixed values: concept nouns, abstract types, and the least number of events of an entity by type
CONCEPTS = ("death", "duty", "virtue", "sin", "righteousness", "courage", "honor", "shame", "fate", "destiny", "time", "age", "moment", "night", "day", "year", "action", "deed", "consequence", "result")
ABSTRACT_TYPES = ("DEATH", "VOW", "BOON", "CURSE")
MIN_SUPPORT = {"PERSON": 2, "GROUP": 1, "PLACE": 1, "TIME": 1, "LITERAL": 0}
# fixed values: recovery of places
KNOWN_PLACES = (
    "kurukshetra", "indraprastha", "hastinapur", "dwarka", "panchala", "matsya", "khandavaprastha", "bharata", "kuru", "anga", "magadha", "videha", "kashi", "kalinga",
    "sindhu", "sauvira", "avanti", "malwa", "chedi", "salya", "trigarta", "uttara", "dakshin", "uttaravahini", "dakshinayana", "india", "bharat", "subhara", "viratha",
)
EPITHETS = (
    "partha", "dhananjaya", "bhimasena", "janardana", "vasudeva", "keshava", "govinda", "kesari", "vrikodara", "arjuna", "bhima", "krishna", "yudhishthira", "nakula", "sahadeva", "draupadi",
    "duryodhana", "karna", "bhishma", "drona", "ashwatthama", "shikhandin", "abhimanyu", "pandu", "kunti", "dhritarashtra", "gandhari", "vidura", "shalya", "shakuni", "subhadra",
)
PLACE_EXCLUDED = (
    "right", "his", "her", "their", "him", "them", "downloaded", "dharma", "karma", "the", "a", "an", "and", "or", "in", "at", "not", "slander", "tanks", "forests", "garlands", "floral",
    "island", "seven", "islands", "supreme", "felicity", "woodland",
)
PLACE_ABSTRACT = "slander|garland|felicity|supreme|woodland|tank|forest|flower|virtue|sin|honor|shame|fate|destiny|action|deed|night|day|year|moment|age"
PLACE_PATTERNS = (
    r"\bat\s+([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)",
    r"\bin\s+([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)",
    r"\bfield of\s+([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)",
    r"\bnear\s+([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)",
)
# fixed values: reranking and evidence
DEATH_KEYWORDS = ("killed", "slew", "slain", "death", "fell", "struck", "beheaded", "cut off", "pierced", "shot")
DEATH_VERBS = ("killed", "slew", "slain", "fell", "cut down", "shot", "struck", "laid low", "death")
ACTION_KEYWORDS = ("killed", "slew", "slain", "defeated", "command", "leader", "senapati", "appointed", "made", "became", "fell", "died")
STOPWORDS = (
    "the", "and", "of", "in", "to", "a", "an", "on", "at", "by", "for", "with", "as", "from", "that", "this", "these", "those", "who", "whom", "whose", "which", "what", "when", "where", "how", "why",
    "is", "was", "were", "are", "be", "been", "it", "its", "their", "his", "her", "him", "she", "he", "they", "them", "you", "your", "yours", "we", "our", "ours", "but", "or",
)
EXPANSIONS = ("death of %s", "%s death", "%s slain in battle", "%s killed in battle", "%s slain", "%s fall in battle", "%s defeat")
WAR_BOOKS = {"Bhishma Parva": 1.08, "Drona Parva": 1.10, "Karna Parva": 1.08, "Shalya Parva": 1.05, "Sauptika Parva": 1.05}
OWN_BOOK_BOOST = 1.12
AGENTS = {
    "karna": ("Arjuna", ("arjuna", "partha", "dhananjaya", "pandava", "parth")),
    "drona": ("Dhrishtadyumna", ("dhrishtadyumna", "dhristadyumna", "panchala prince", "prince of the panchalas")),
    "bhishma": ("Shikhandi and Arjuna", ("shikhandi", "shikhandin", "arjuna", "partha", "dhananjaya")),
    "jayadratha": ("Arjuna", ("arjuna", "partha", "dhananjaya")),
    "bhurishravas": ("Satyaki", ("satyaki", "yuyudhana")),
}
# fixed values: second hop of a benefit question, by the written specification of answers
BENEFIT_TYPES = ("APPOINTED_AS", "CORONATION", "BOON", "SUPPORTED", "COMMAND", "RESCUED")
# fixed values: headers of books (over several lines, or inline), the books' names, and spellings that are mended
BOOK_HEADER = r"^\s*BOOK\s+(\d{1,2})\s*(?:\r?\n\s*[^\n]*?){0,3}\r?\n\s*([A-Z][A-Z \-]+PARVA)\b"
BOOK_HEADER_INLINE = r"^\s*BOOK\s+(\d{1,2})\s*:\s*([A-Z][^\n]*?PARVA)\b"
BOOK_NAMES = (
    "Adi Parva", "Sabha Parva", "Vana Parva", "Virata Parva", "Udyoga Parva", "Bhishma Parva", "Drona Parva", "Karna Parva", "Shalya Parva",
    "Sauptika Parva", "Stri Parva", "Shanti Parva", "Anushasan Parva", "Ashvamedhika Parva", "Ashramavasika Parva", "Mausala Parva", "Mahaprasthanika Parva", "Svargarohanika Parva",
)
BOOK_SPELLINGS = {"Santi Parva": "Shanti Parva", "Anusasana Parva": "Anushasan Parva", "Aswamedha Parva": "Ashvamedhika Parva", "Asramavasika Parva": "Ashramavasika Parva"}
# fixed values: the older question parser
PARSER_NAMES = ("Arjuna", "Yudhishthira", "Bhima", "Draupadi", "Krishna", "Karna", "Duryodhana", "Ashvatthama", "Drona", "Bhishma")
PARSER_PHASES = {
    "Origins": ("creation", "ancient", "beginning"),
    "RiseOfThePandavas": ("rise", "youth", "swayamvara"),
    "Exile": ("exile", "forest", "agyatvasa", "wandering"),
    "PreludeToWar": ("prelude", "negotiation", "diplomacy"),
    "KurukshetraWar": ("war", "kurukshetra", "battle"),
    "ImmediateAftermath": ("aftermath", "mourning"),
    "PostWarInstruction": ("instruction", "teaching"),
    "WithdrawalFromTheWorld": ("withdrawal", "heaven", "death"),
}
PARSER_INTENTS = {"temporal": ("when", "during", "time"), "location": ("where", "location", "place"), "causal": ("why", "reason", "cause"), "narrative": ("what happened", "what did")}
PARSER_SCOPES = {"agyatvasa": "Exile.Year13.Agyatvasa", "forest": "Exile.ForestYears", "war": "KurukshetraWar"}
PARSER_ALIASES = {
    "partha": "Arjuna", "dhananjaya": "Arjuna", "brihannala": "Arjuna", "dharmaraja": "Yudhishthira", "kanka": "Yudhishthira", "bhimasena": "Bhima", "vrikodara": "Bhima", "ballava": "Bhima",
    "krishnaa": "Draupadi", "panchali": "Draupadi", "sairindhri": "Draupadi", "vasudeva": "Krishna", "hari": "Krishna", "govinda": "Krishna",
}
# fixed values: the property graph's node types with their attributes, and its edge types
NODE_TYPES = {
    "ContextUnit": ("unit_id", "parva", "section", "story_phase", "text"),
    "Character": ("name", "role", "parva_first_appearance"),
    "Alias": ("alias_name", "canonical_name"),
    "Parva": ("parva_number", "name"),
    "Section": ("parva", "section_number"),
    "StoryPhase": ("phase_name", "parvas"),
    "Concept": ("concept_name",),
}
LINK_TYPES = ("APPEARS_IN", "ALIAS_OF", "PART_OF", "DURING", "NEXT", "MENTIONS", "RELATED_TO")
CORE_CONCEPTS = ("Dharma", "Karma", "Exile", "War", "Kingship", "Duty", "Lineage", "Curse", "Fortune", "Betrayal", "Loyalty", "Victory", "Defeat", "Death", "Rebirth")
# fixed values: what the profile of a graph counts
PROFILE_PRONOUNS = ("thou", "thee", "thy", "him", "her", "they", "them", "his", "hers", "who", "whom", "he", "she", "it", "we", "you")
PROFILE_NOISE = ("having ", "being ", "the presence", "the act of")
PROFILE_TARGETS = {"events": (500, 1500), "entities": (2000, 3500)}
