"""Fixed values."""

# The English stop words of the public NLTK corpus, in its order.
STOP_WORDS = tuple(
    """a about above after again against ain all am an and any are aren aren't as at be because been before being below
between both but by can couldn couldn't d did didn didn't do does doesn doesn't doing don don't down during each few for from
further had hadn hadn't has hasn hasn't have haven haven't having he he'd he'll her here hers herself he's him himself his how i
i'd if i'll i'm in into is isn isn't it it'd it'll it's its itself i've just ll m ma me mightn mightn't more most mustn mustn't my
myself needn needn't no nor not now o of off on once only or other our ours ourselves out over own re s same shan shan't she she'd
she'll she's should shouldn shouldn't should've so some such t than that that'll the their theirs them themselves then there these
they they'd they'll they're they've this those through to too under until up ve very was wasn wasn't we we'd we'll we're were weren
weren't we've what when where which while who whom why will with won won't wouldn wouldn't y you you'd you'll your you're yours
yourself yourselves you've""".split()
)

# Commands that begin a source block and are no part of what it states, in the order in which they are tried.
COMMANDS = tuple(
    """lift_definition quotient_definition definition abbreviation fun function primrec primcorec datatype codatatype record
type_synonym typedef inductive_set inductive coinductive_set coinductive partial_function quotient_type axiomatization specification
locale class consts domain fixrec nominal_datatype nominal_function nominal_primrec concrete_definition sepref_definition
locset_definition corecursive corec datatype_record pcpodef cpodef domaindef AOT_theorem AOT_act_theorem AOT_lemma AOT_define
AOT_axiom AOT_act_axiom theorem lemma corollary proposition schematic_goal tts_lemma""".split()
)

# Thresholds of the duplicate analysis and limits of searches.
STRONG_DISTANCE = 0.05
DISTANCE = 0.3
SYNTACTIC = 0.9
MAX_JUDGED = 3
TRUTH_MIN_CHARS = 8
TRUTH_SIMILARITY = 0.85
TRUTH_GROUP = 50
SELF_EXTRA = 301
SELF_FAILURES = 0.05
CANDIDATES = 500
MAX_LIMIT = 1000
HIT_CUTOFF = 10
EXCERPT_CHARS = 3000
METADATA_CHARS = 300
REPORT_CHARS = 600
HISTOGRAM = (0.05, 0.1, 0.2, 0.3, 0.5, 1.0)
TIERS = ("near-exact", "likely", "possible")
VERDICTS = ("DUPLICATE", "VARIANT", "RELATED", "DIFFERENT")
DRIFT = 0.001
