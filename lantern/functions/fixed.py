"""Word lists, suffix lists, code tables and names that results depend on."""

# Stop words (22 English, then Russian).
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the to was were with "
    "без бы был была были было быть в вам вас весь во вот все всего всех вы где да для "
    "до его ее если есть еще же за и из или им их к как ко когда кто ли либо мне может "
    "мы на над надо наш не него нее нет ни них но о об однако он она они оно от по под "
    "при про с со так также там те тем то того тоже той только том ты у уже что чтобы это "
    "этого этой этом этот я"
).split()

# Russian suffixes in order of trial.
RUSSIAN_SUFFIXES = (
    "иями ями ами иях ах ях ого его ому ему ыми ими ешь ете ает ают яет яют ить ится "
    "ать ться ее ие ые ое ая яя ый ий ой ам ям ов ев ей ия ья ью ии ть ти "
    "ся ет ют ут ит ат ят ем им ым ом ую юю а я ы и о е у ю ь"
).split()

# English suffixes in order of trial.
ENGLISH_SUFFIXES = (
    "ization ational fulness ousness iveness tional ing edly edly ment ness able ible ions tion sion ies ied ed ly es s"
).split()

# Groups of words that stand for each other.
ALIAS_GROUPS = (
    "поиск искать найти нахождение search find retrieve",
    "смысл семантика значение контекст meaning semantic context",
    "документ файл материал источник document file source",
    "фрагмент абзац цитата отрывок paragraph snippet quote",
    "договор контракт соглашение contract agreement",
    "стоимость цена тариф сумма оплата payment price cost",
    "срок дата дедлайн период time date deadline",
    "ответственность штраф санкция penalty liability",
    "клиент заказчик покупатель customer client",
    "исполнитель поставщик подрядчик vendor supplier",
    "модель нейросеть ml ai embedding эмбеддинг",
    "pdf docx txt markdown md конспект",
)

# The single-byte code page's characters at 0x80 to 0xBF that are known ("?" otherwise).
CODE_PAGE = {
    0x82: "‚", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "€", 0x89: "‰",
    0x91: "‘", 0x92: "’", 0x93: "“", 0x94: "”", 0x95: "•", 0x96: "–", 0x97: "—",
    0x99: "™", 0x9A: "љ", 0x9C: "њ", 0x9E: "ў", 0x9F: "џ", 0xA0: " ", 0xA5: "Ґ",
    0xA7: "§", 0xA8: "Ё", 0xAA: "Є", 0xAB: "«", 0xAD: "­", 0xAF: "Ї", 0xB2: "І",
    0xB3: "і", 0xB4: "ґ", 0xB8: "ё", 0xB9: "№", 0xBA: "є", 0xBB: "»", 0xBF: "ї",
}

# Directories that are not entered, and extensions that are read.
SKIPPED_DIRECTORIES = (
    ".docsearch_cache .git .hg .svn .idea .vs build cmake-build-debug cmake-build-release node_modules .venv venv __pycache__"
).split()
EXTENSIONS = ".txt .text .md .markdown .docx .pdf".split()

#: Our own cache of texts below a working directory.
CACHE_DIRECTORY = ".lantern_cache"

# Labels of the metadata fragment, and what it says of a file without text.
META_NAME, META_TITLE, META_PATH, META_TYPE = "Имя файла: ", "Название: ", "Путь: ", "Тип файла: "
META_NO_TEXT = (
    "Текст документа не извлечен. Возможно, PDF состоит из сканов или фотографий без OCR. "
    "Файл добавлен в индекс только по названию и пути.\n"
)

# Ranking constants.
K1, B = 1.45, 0.72
ALIAS_WEIGHT, ONE_EDIT_WEIGHT, TWO_EDIT_WEIGHT = 0.62, 0.50, 0.36
FUZZY_CANDIDATES, FUZZY_ADDED = 256, 10
FRAGMENT_BYTES, SENTENCE_BYTES = 1400, 80
SEGMENT_DOCS, SEGMENT_FRAGMENTS = 64, 384

# Texts of the task list.
REASON_URGENT, REASON_MEDIUM = "высокая срочность", "средняя срочность"
REASON_HARD = "задача требует хорошей концентрации"
REASON_SHORT, REASON_SHORT_END = "ее можно закрыть примерно за ", " минут"
REASON_HOUR = "она не займет слишком много времени"
REASON_DEFAULT = "это сейчас самый сбалансированный вариант"
REASON_AND = " и "
TIP_SHORT = "Подсказка: если времени мало, начни с короткой задачи и быстро получи результат."
TIP_HARD = "Подсказка: если есть силы и концентрация, сейчас хороший момент взяться за сложное."
TIP_DEFAULT = "Подсказка: начни с этой задачи, чтобы сохранить темп и постепенно разгрузить список."
STATUS_DONE, STATUS_ACTIVE = "выполнено", "активна"
NOTHING_FOUND = "Ничего не найдено."
ANSWER_HEAD, SOURCES_HEAD = "Ответ по найденным локальным фрагментам:", "Источники:"
