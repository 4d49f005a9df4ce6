"""Word lists and patterns that decide how questions are read and which facts a text holds."""

from __future__ import annotations

# fixed values: words that carry no meaning of their own
STOPWORDS = """about after again all am an and any are as at be been before being but by can could did do does each find for
from get give had has have he her here his how if in into is it its just know me much my need no not of on or our out over
please said say says she should show so some tell than that the their them then there these they this to up us was we were
what when where which who why will with would you your""".split()

# fixed values: short forms and what they stand for
CONTRACTIONS = {
    "what's": "what is", "when's": "when is", "where's": "where is", "who's": "who is", "how's": "how is", "that's": "that is",
    "there's": "there is", "it's": "it is", "i'm": "i am", "isn't": "is not", "aren't": "are not", "wasn't": "was not",
    "doesn't": "does not", "don't": "do not", "didn't": "did not", "can't": "can not", "won't": "will not",
    "shouldn't": "should not", "couldn't": "could not", "i've": "i have", "i'd": "i would",
}

# fixed values: words that tell what kind of answer is wanted, in the order in which the kinds are tried
INTENTS = {
    "amount": "much cost costs price prices total totals amount amounts fee fees charge charges pay paid payable balance owe owed sum sums rate refund deposit discount tax figures".split(),
    "date": "when date dates deadline deadlines due expires expiry expiration starts start ends end valid renewal renew day month year period".split(),
    "contact": "phone phones telephone mobile email emails contact contacts call".split(),
    "identifier": "number numbers reference references ref code codes account policy invoice id serial".split(),
    "place": "where address addresses location locations premises property city street postcode zip".split(),
    "person": "who whom whose name names named signed signatory signatories tenant landlord customer holder client owner people person".split(),
}
SHAPED = ("amount", "date", "contact", "identifier", "person")

# fixed values: words and phrases of the request itself
SUMMARY = "summarise summarize summarised summarized summary summaries overview gist tldr recap synopsis outline points takeaways highlights".split()
BRIEF = "brief briefly short shortly quick quickly tldr concise concisely one two".split()
EXPLAIN = "explain explanation clarify meaning means mean".split()
ABOUT = "purpose topic topics theme regarding concerning".split()
MANNER = "simply simple plainly plain easily easy basically layman laymans".split()
RECENCY = "latest newest recent recently last current".split()
ENUMERATION = "find list show all every any extract pull".split()
PLURALS = "dates deadlines names signatories people amounts costs prices charges fees totals figures numbers references codes addresses locations contacts emails phones".split()
MENTION = "mentioned mention mentions listed included contains contain".split()
QUALIFIER = "important key main major significant relevant useful mentioned listed notable critical essential".split()
ITSELF = "document documents doc file page pages text scan paper contents content information info details detail facts data section sections passage paragraph paragraphs".split()
SUMMARY_PHRASES = ("key points", "main points", "key takeaways", "in short")
ABOUT_PHRASES = ("what is this", "what kind of document", "what type of document", "what document is this")
ENUMERATION_PHRASES = ("what are the", "list of", "are there any")
ABOUT_PATTERN = r"^(what|what's|whats)\s+(is|are|was|were|s)?\s*[a-z0-9 '’-]{0,40}\babout\s*[?.!]*$"

# fixed values: words that mean nearly the same
SYNONYMS = [g.split() for g in (
    "bill invoice statement receipt", "contract agreement lease tenancy", "policy cover coverage insurance", "prescription medication medicine",
    "passport id identification identity", "licence license permit", "warranty guarantee", "amount total sum balance payable", "cost price charge fee rate",
    "paid payment settled", "refund reimbursement rebate", "deposit bond security", "discount reduction", "tax vat gst", "due deadline payable owing",
    "expires expiry expiration valid", "start starts commencement begins", "end ends termination expiry", "renewal renew renewed", "period term duration",
    "tenant renter lessee occupant", "landlord lessor owner", "customer client account holder", "supplier provider vendor company",
    "address location premises property", "phone telephone mobile contact", "email mail", "number no reference ref code", "account acct",
    "electricity electric power energy", "water sewerage", "gas heating", "internet broadband wifi", "rent rental",
)]

# fixed values: capitalised pairs with these words are no names
FURNITURE = """account address amount avenue balance bank billing card close court crescent drive lane road square street terrace
way charge charges closing code conditions contact credit current customer date dates dear debit delivery description detail
details due email gross grand invoice item items madam mobile month net new note notes number opening order page payable
payment payments period phone please previous price quantity rate receipt reference service services shipping sir statement
sub subtotal summary tax telephone terms thank thanks total unit units valid vat year your""".split()
ORGANISATIONS = """associates authority bank college company corporation council energy foundation group holdings hospital inc
incorporated institute insurance limited llc llp ltd partners plc school services society solutions systems technologies
trust university utilities""".split()

# fixed values: the shapes of facts; \b is a boundary of ASCII words
_MONTH = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t|tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_CAPS = r"(?:[A-Z][a-zA-Z]+\s+){1,3}"
SHAPES = {
    "date": r"\b[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{2,4}\b",
    "written_date": rf"(?i)\b{_MONTH}\.?\s+[0-9]{{1,2}}(?:,?\s+[0-9]{{4}})?\b|\b[0-9]{{1,2}}\s+{_MONTH}\b(?:,?\s+[0-9]{{4}})?",
    "amount": r"(?i)(?:[€£$¥₹]|\b(?:eur|usd|gbp|pkr|inr|chf)\b)\s?[0-9](?:[0-9 ,.]*[0-9])?|\b[0-9]{1,3}(?:[ ,][0-9]{3})+(?:[.,][0-9]{1,2})?\b|\b[0-9]+[.,][0-9]{2}\b",
    "email": r"\b[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+\b",
    "phone": r"(?:\+[0-9][0-9\s().-]{7,})|(?:\b[0-9][0-9\s().-]{8,}[0-9]\b)",
    "identifier": r"\b(?=[A-Za-z0-9-]*[0-9])[A-Za-z0-9-]{6,}\b",
    "name": r"\b[A-Z][a-z]+[ \t]+[A-Z][a-z]+\b",
    "street": rf"\b[0-9]{{1,4}}[a-z]?[,\s]+{_CAPS}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Close|Court|Ct|Crescent|Square|Sq|Way|Terrace|Place|Boulevard|Blvd|Parade|Row)\b\.?|\b{_CAPS}(?:Street|Road|Avenue|Lane|Drive|Crescent|Square|Terrace|Boulevard)\b",
    "postcode": r"\b[A-Z]{1,2}[0-9][A-Z0-9]?\s?[0-9][A-Z]{2}\b",
}
#: the shapes that answer an intent
ANSWERS = {"date": ("date", "written_date"), "amount": ("amount",), "contact": ("email", "phone"), "identifier": ("identifier",), "person": ("name",), "place": ("street", "postcode")}

VOCABULARY = sorted({w for words in INTENTS.values() for w in words})
REQUEST = sorted({*SUMMARY, *EXPLAIN, *ABOUT, *MANNER, *RECENCY, *ENUMERATION, *QUALIFIER, *MENTION, *ITSELF})
POINTING = sorted({*ITSELF, *QUALIFIER, *RECENCY})
WHOLE_DOCUMENT = sorted({*STOPWORDS, *ITSELF, *QUALIFIER, *EXPLAIN, *SUMMARY, *ABOUT, *MANNER, *RECENCY})
ALTERNATIVES = {t: sorted({o for g in SYNONYMS if t in g for o in g} - {t}) for g in SYNONYMS for t in g}


def java(pattern: str) -> str:
    r"""The pattern with \b as a boundary of ASCII words on every Java version.

    Before a letter or digit that is a look back, and what has to follow is looked at first, which most places fail.
    """
    word = "[A-Za-z0-9_]"
    for first in ("[0-9]", "[A-Z]", "(?:[A-Z]", "(?:jan", "(?:eur"):
        ahead = {"(?:[A-Z]": "(?=[A-Z])", "(?:jan": "(?=[adfjmnos])", "(?:eur": "(?=[ceginpu])"}.get(first, f"(?={first})")
        pattern = pattern.replace(rf"\b{first}", f"{ahead}(?<!{word}){first}")
    return pattern.replace(r"\b", f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))")
