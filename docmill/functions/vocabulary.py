"""Word lists and tables whose values fix results."""

from __future__ import annotations

# Words that ranked retrieval leaves out of queries.
STOPWORDS = frozenset(
    "the a an is are was were be been being have has had do does did will would could should may might must shall can need dare ought used to of in for on with at by from as into through "
    "during before after above below between under again further then once here there when where why how all each few more most other some such no nor not only own same so than too very just "
    "and but or if because until while this that these those it its they them their what which who whom whose we you your he him his she her".split()
)
# Words that TF-IDF leaves out.
TFIDF_STOPWORDS = frozenset("the a an is are was were be been to of and or in on at for with it this that from by as can will have has had do does did".split())

# Fixed values: (abbreviation, full form).
ABBREVIATIONS = [
    ("btn", "button"), ("btns", "buttons"), ("img", "image"), ("imgs", "images"), ("nav", "navigation"), ("hdr", "header"), ("ftr", "footer"), ("dlg", "dialog"), ("mod", "modal"),
    ("lbl", "label"), ("txt", "text"), ("chk", "checkbox"), ("chkbox", "checkbox"), ("rad", "radio"), ("sel", "select"), ("opt", "option"), ("opts", "options"),
    ("drp", "dropdown"), ("tbl", "table"), ("col", "column"), ("cols", "columns"), ("row", "row"), ("rows", "rows"), ("pg", "page"), ("pgs", "pages"), ("sec", "section"),
    ("secs", "sections"), ("cmp", "component"), ("cmps", "components"), ("elem", "element"), ("elems", "elements"), ("cfg", "configuration"), ("config", "configuration"),
    ("configs", "configurations"), ("init", "initialize"), ("auth", "authentication"), ("authn", "authentication"), ("authz", "authorization"), ("msg", "message"),
    ("msgs", "messages"), ("err", "error"), ("errs", "errors"), ("warn", "warning"), ("warns", "warnings"), ("info", "information"), ("req", "request"), ("reqs", "requests"),
    ("res", "response"), ("resp", "response"), ("resps", "responses"), ("cb", "callback"), ("fn", "function"), ("func", "function"), ("funcs", "functions"), ("param", "parameter"),
    ("params", "parameters"), ("arg", "argument"), ("args", "arguments"), ("val", "value"), ("vals", "values"), ("var", "variable"), ("vars", "variables"), ("const", "constant"),
    ("consts", "constants"), ("prop", "property"), ("props", "properties"), ("attr", "attribute"), ("attrs", "attributes"), ("evt", "event"), ("evts", "events"),
    ("ref", "reference"), ("refs", "references"), ("doc", "document"), ("docs", "documents"), ("dir", "directory"), ("dirs", "directories"), ("env", "environment"),
    ("envs", "environments"), ("dev", "development"), ("prod", "production"), ("stg", "staging"), ("db", "database"), ("dbs", "databases"), ("api", "interface"),
    ("repo", "repository"), ("repos", "repositories"), ("pkg", "package"), ("pkgs", "packages"), ("lib", "library"), ("libs", "libraries"), ("dep", "dependency"),
    ("deps", "dependencies"), ("util", "utility"), ("utils", "utilities"), ("src", "source"), ("dest", "destination"), ("tmp", "temporary"), ("temp", "temporary"),
    ("max", "maximum"), ("min", "minimum"), ("avg", "average"), ("std", "standard"), ("num", "number"), ("nums", "numbers"), ("idx", "index"), ("len", "length"), ("cnt", "count"),
    ("qty", "quantity"), ("amt", "amount"), ("pct", "percent"), ("perc", "percentage"), ("desc", "description"), ("spec", "specification"), ("specs", "specifications"),
    ("impl", "implementation"), ("impls", "implementations"), ("exe", "execute"), ("exec", "execute"), ("cmd", "command"), ("cmds", "commands"), ("async", "asynchronous"),
    ("sync", "synchronous"), ("prev", "previous"), ("cur", "current"), ("curr", "current"),
]

# Groups of words that stand for each other.
SYNONYMS = [
    ("button", "btn"), ("dialog", "modal", "popup", "overlay"), ("input", "textfield", "textbox", "field"), ("dropdown", "select", "combobox", "picker"),
    ("checkbox", "check", "toggle"), ("switch", "toggle"), ("slider", "range"), ("accordion", "collapsible", "expandable"), ("tabs", "tablist", "tabpanel"),
    ("tooltip", "hint", "popover"), ("notification", "alert", "toast", "snackbar"), ("spinner", "loader", "loading"), ("skeleton", "placeholder", "shimmer"),
    ("avatar", "profile", "userpic"), ("badge", "tag", "chip", "pill"), ("card", "tile", "panel"), ("list", "listbox", "menu"), ("grid", "layout", "container"),
    ("sidebar", "drawer", "nav"), ("breadcrumb", "breadcrumbs", "navigation"), ("create", "add", "new", "insert"), ("delete", "remove", "destroy", "drop"),
    ("update", "edit", "modify", "change"), ("get", "fetch", "retrieve", "read", "load"), ("save", "store", "persist", "write"), ("search", "find", "query", "filter", "lookup"),
    ("show", "display", "render", "view"), ("hide", "conceal", "collapse"), ("open", "expand", "show"), ("close", "collapse", "hide", "dismiss"), ("enable", "activate", "turn on"),
    ("disable", "deactivate", "turn off"), ("validate", "verify", "check"), ("submit", "send", "post"), ("cancel", "abort", "discard"), ("reset", "clear", "empty"),
    ("refresh", "reload", "update"), ("import", "load", "read"), ("export", "save", "download"), ("upload", "import", "send"), ("download", "export", "fetch"),
    ("active", "selected", "current", "focused"), ("disabled", "inactive", "readonly"), ("error", "invalid", "failed"), ("success", "valid", "passed"),
    ("loading", "pending", "processing"), ("empty", "blank", "none", "null"), ("auth", "authentication", "login", "signin"), ("logout", "signout", "logoff"),
    ("permission", "access", "role", "authorization"), ("user", "account", "profile"), ("settings", "preferences", "options", "config"), ("theme", "style", "appearance", "skin"),
    ("dark", "night", "dark mode"), ("light", "day", "light mode"),
]

# Section types by keyword, in the order in which they are tried.
SECTION_KEYWORDS = [
    ("props", ["props", "api", "properties", "attributes", "parameters"]),
    ("example", ["example", "usage", "demo", "sample"]),
    ("variant", ["variant", "variation", "style", "size", "color", "theme"]),
    ("accessibility", ["accessibility", "a11y", "aria", "keyboard", "screen reader"]),
    ("styling", ["styling", "css", "theming", "customization", "design token"]),
    ("migration", ["migration", "upgrade", "changelog", "breaking change"]),
    ("best_practices", ["best practice", "guideline", "recommendation", "pattern"]),
]
# All chunk types.
CHUNK_TYPES = ["overview", *[t for t, _ in SECTION_KEYWORDS], "inputs", "outputs", "methods", "source", "template", "stylesheet"]

# Folders that name a category.
CATEGORY_FOLDERS = "forms buttons layout navigation data-display feedback overlay typography icons tables inputs modals dialogs menus cards".split()
# Folders that name none.
PLAIN_FOLDERS = "lib src app components".split()
# Tags that are no components.
PLAIN_TAGS = "Fragment React Component Provider".split()

# Fixed values: (pattern, file type), in the order in which they are tried.
FILE_TYPES = [
    (r"\.component\.ts$", "component"), (r"\.service\.ts$", "service"), (r"\.module\.ts$", "module"), (r"\.directive\.ts$", "directive"), (r"\.pipe\.ts$", "pipe"), (r"\.guard\.ts$", "guard"),
    (r"\.interceptor\.ts$", "interceptor"), (r"\.component\.html$", "template"), (r"\.component\.scss$", "stylesheet"), (r"\.spec\.ts$", "test"), (r"\.test\.ts$", "test"),
]
# Language by extension.
LANGUAGES = {"typescript": ["ts", "tsx"], "javascript": ["js", "jsx"], "html": ["html", "htm"], "scss": ["scss", "sass", "css"], "python": ["py"]}
# Endings that a component's name goes without.
NAME_SUFFIXES = ["Component", "Service", "Module", "Directive", "Pipe"]
