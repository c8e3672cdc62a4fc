"""How a field's text is read, by its name."""

MODES = (
    dict.fromkeys("author editor translator bookauthor editora editorb editorc annotator commentator collaborator director holder afterword foreword introduction shortauthor shorteditor".split(), "creatorlist")
    | dict.fromkeys("title booktitle series subtitle shorttitle maintitle booksubtitle mainsubtitle titleaddon booktitleaddon maintitleaddon issuetitle eventtitle".split(), "title")
    | dict.fromkeys("note annote annotation abstract".split(), "richtext")
    | dict.fromkeys("publisher institution organization location origpublisher language".split(), "literallist")
    | dict.fromkeys("url doi eprint file ids pdf verba verbb verbc urlraw".split(), "verbatim")
)


def mode_of(name: str) -> str:
    return MODES.get(name, "literal")


MONTHS = {name: str(n) for n, names in enumerate(zip("jan feb mar apr may jun jul aug sep oct nov dec".split(), "january february march april may june july august september october november december".split(), strict=True), 1) for name in names}
#: Macros that every document has.
BUILT_IN = {"JACM": "Journal of the ACM"}
