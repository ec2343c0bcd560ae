"""The closed vocabulary of background noise: folding, normalising and comparing terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The terms that may be emitted, in the order that settles ties.
CANONICAL = (
    "office chatter", "music", "road noise", "television", "keyboard typing", "wind", "mechanical noise",
    "static",
    "crowd noise", "traffic", "children", "baby crying", "dog barking", "phone ringing", "alarm",
    "construction", "appliance", "restaurant noise", "rain", "echo", "hum", "footsteps", "paper rustling",
    "breathing",
)

# Words that qualify a noise without naming it.
QUALIFIERS = (
    "sharp", "loud", "faint", "slight", "heavy", "mild", "soft", "harsh", "constant", "intermittent",
    "occasional", "low", "high", "moderate", "background", "some", "light", "strong", "distant", "muffled",
    "steady", "level", "audible", "noticeable", "minor", "significant",
)

# Other names of the terms, in the order in which they are tried.
ALIASES = {
    "tv": "television", "telly": "television", "tv noise": "television", "tv in background": "television",
    "tv show": "television", "television set": "television", "broadcast": "television",
    "hiss": "static", "white noise": "static", "line noise": "static", "crackle": "static",
    "crackling": "static", "interference": "static", "signal noise": "static", "buzzing": "static",
    "buzz": "static", "electrical noise": "static", "noise": "static",
    "chatter": "office chatter", "babble": "office chatter", "speech babble": "office chatter",
    "background voices": "office chatter", "background speech": "office chatter", "voices": "office chatter",
    "people talking": "office chatter", "conversation": "office chatter", "office noise": "office chatter",
    "background conversation": "office chatter",
    "car": "road noise", "engine": "road noise", "vehicle": "road noise", "driving": "road noise",
    "car noise": "road noise", "traffic noise": "traffic", "cars": "traffic", "street noise": "traffic",
    "typing": "keyboard typing", "keyboard": "keyboard typing", "keystrokes": "keyboard typing",
    "computer keyboard": "keyboard typing", "clicking": "keyboard typing",
    "machinery": "mechanical noise", "motor": "mechanical noise", "fan": "mechanical noise",
    "fan noise": "mechanical noise", "air conditioning": "mechanical noise", "hvac": "mechanical noise",
    "humming": "hum", "mains hum": "hum", "electrical hum": "hum",
    "vacuum": "appliance", "vacuum cleaner": "appliance", "blender": "appliance", "dishes": "appliance",
    "kitchen noise": "appliance",
    "crowd": "crowd noise", "people": "crowd noise", "restaurant": "restaurant noise",
    "cafe": "restaurant noise", "cafe noise": "restaurant noise", "bar noise": "restaurant noise",
    "kids": "children", "child": "children", "children playing": "children", "baby": "baby crying",
    "infant crying": "baby crying", "crying": "baby crying", "dog": "dog barking", "barking": "dog barking",
    "ringtone": "phone ringing", "phone": "phone ringing", "siren": "alarm", "beeping": "alarm",
    "alarm sound": "alarm", "drilling": "construction", "hammering": "construction", "reverb": "echo",
    "reverberation": "echo", "wind noise": "wind", "breeze": "wind", "music playing": "music",
    "radio": "music", "song": "music", "rustling": "paper rustling", "paper": "paper rustling",
    "breath": "breathing", "heavy breathing": "breathing",
}

# Classes of a sound tagger, by their display names, and the terms they stand for.
CLASSES = {
    "Television": "television", "Radio": "television",
    "Music": "music", "Musical instrument": "music", "Singing": "music", "Pop music": "music",
    "Background music": "music",
    "Babble": "office chatter", "Speech babble": "office chatter", "Chatter": "office chatter",
    "Hubbub, speech noise, speech babble": "office chatter", "Crowd": "crowd noise",
    "Typing": "keyboard typing", "Computer keyboard": "keyboard typing", "Typewriter": "keyboard typing",
    "Mouse click": "keyboard typing",
    "Wind": "wind", "Wind noise (microphone)": "wind", "Rustling leaves": "wind",
    "Vehicle": "road noise", "Car": "road noise", "Engine": "road noise", "Motor vehicle (road)": "road noise",
    "Traffic noise, roadway noise": "traffic", "Truck": "traffic",
    "Static": "static", "White noise": "static", "Pink noise": "static", "Hiss": "static", "Noise": "static",
    "Cacophony": "static", "Mains hum": "hum", "Hum": "hum", "Buzz": "hum",
    "Mechanisms": "mechanical noise", "Machine": "mechanical noise", "Air conditioning": "mechanical noise",
    "Fan": "mechanical noise", "Engine (idling)": "mechanical noise",
    "Vacuum cleaner": "appliance", "Blender": "appliance", "Dishes, pots, and pans": "appliance",
    "Water tap, faucet": "appliance",
    "Baby cry, infant cry": "baby crying", "Crying, sobbing": "baby crying", "Children playing": "children",
    "Children shouting": "children", "Dog": "dog barking", "Bark": "dog barking",
    "Telephone bell ringing": "phone ringing", "Ringtone": "phone ringing",
    "Alarm": "alarm", "Siren": "alarm", "Beep, bleep": "alarm",
    "Jackhammer": "construction", "Drill": "construction", "Sawing": "construction", "Hammer": "construction",
    "Rain": "rain", "Raindrop": "rain", "Echo": "echo", "Reverberation": "echo",
    "Walk, footsteps": "footsteps", "Writing": "paper rustling", "Crumpling, crinkling": "paper rustling",
    "Breathing": "breathing",
}

# Classes that are the call itself, or too general to name a noise.
IGNORED = (
    "Speech", "Male speech, man speaking", "Female speech, woman speaking", "Conversation",
    "Narration, monologue", "Silence", "Inside, small room", "Inside, large room or hall", "Sound effect",
    "Speech synthesizer", "Child speech, kid speaking", "Whispering",
    "Telephone", "Dial tone", "Sidetone", "Busy signal", "Telephone dialing, DTMF", "Telephone bell ringing",
    "Animal", "Domestic animals, pets", "Sounds of things", "Human sounds", "Natural sounds",
    "Environmental noise", "Outside, rural or natural", "Outside, urban or manmade", "Generic impact sounds",
    "Wood", "Glass",
)

# Terms that are near misses of one another.
FAMILIES = (
    ("road noise", "traffic", "mechanical noise", "hum"),
    ("office chatter", "crowd noise", "restaurant noise", "television"),
    ("static", "hum", "echo"),
    ("music", "television"),
    ("children", "baby crying"),
    ("appliance", "mechanical noise", "construction"),
)


def _folded(name: str) -> str:
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in name.lower()).split())


FOLDED_CLASSES = {_folded(name): term for name, term in CLASSES.items()}


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def _words(text: Column) -> Column:
    return F.split(text, " ")


def fold(text: Column) -> Column:
    """Lower case, ASCII letters and digits only, single spaces."""
    plain = F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")
    return F.trim(plain)


def normalize(text: Column) -> Column:
    """The term that a surface form names, the first of these that finds one:

    the folded form as a term, as a tagger class, as an alias; without qualifiers as an alias, as a
    term; the first term, then the first alias, that shares a word with it. Else what is left
    without qualifiers, or the folded form. Null and blank text give ''.
    """
    form = fold(F.coalesce(text, F.lit("")))
    words = F.filter(_words(form), lambda w: ~w.isin(*QUALIFIERS))
    bare = F.array_join(words, " ")
    sharing = lambda names: F.try_element_at(F.filter(F.array(*map(F.lit, names)), lambda n: F.arrays_overlap(_words(n), words)), F.lit(1))
    found = F.coalesce(
        F.when(form.isin(*CANONICAL), form),
        F.try_element_at(_map(FOLDED_CLASSES), form),
        F.try_element_at(_map(ALIASES), form),
        F.try_element_at(_map(ALIASES), bare),
        F.when(bare.isin(*CANONICAL), bare),
        sharing(CANONICAL),
        F.try_element_at(_map(ALIASES), sharing(tuple(ALIASES))),
        F.when(bare != "", bare),
        form,
    )
    return F.when(form == "", F.lit("")).otherwise(found)


def canonical_only(text: Column) -> Column:
    """The term, or '' for text that names none."""
    term = normalize(text)
    return F.when(term.isin(*CANONICAL), term).otherwise("")


def class_term(name: Column) -> Column:
    """The term of a tagger class; null for ignored classes and for those that name no term."""
    term = F.coalesce(F.try_element_at(_map(CLASSES), name), canonical_only(name))
    return F.when(~name.isin(*IGNORED) & (term != ""), term)


def match_terms(truth: Column, predicted: Column) -> Column:
    """Likeness of two normalised terms: 1 if equal, 0.5 if they share a word or a family, else 0."""
    pair = F.array(truth, predicted)
    related = F.lit(False)
    for family in FAMILIES:
        related = related | (F.size(F.array_except(pair, F.array(*map(F.lit, family)))) == 0)
    return (
        F.when(truth == predicted, 1.0)
        .when((truth == "") | (predicted == ""), 0.0)
        .when(F.arrays_overlap(_words(truth), _words(predicted)) | related, 0.5)
        .otherwise(0.0)
    )


def match(truth: Column, predicted: Column) -> Column:
    """Likeness of two surface forms."""
    return match_terms(normalize(truth), normalize(predicted))
