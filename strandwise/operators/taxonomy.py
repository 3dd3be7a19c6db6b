"""Coarse genres."""

# Categories in order of priority, each with the texts that mark it (a text occurs anywhere in a genre).
# One text has a capital, so it never matches lower-cased genres; it is kept as it is.
TAXONOMY = {
    "fantasy": ["fantasy", "epic fantasy", "urban fantasy", "dragons", "magic", "mythical creatures", "fantasy fiction", "american fantasy fiction"],
    "romance": ["romance", "love stories", "historical romance", "contemporary romance", "fiction, romance, contemporary", "fiction, romance, western"],
    "mystery_thriller": ["mystery", "thriller", "crime", "detective", "suspense", "whodunit", "roman policier", "fiction, suspense", "fiction, thrillers", "fiction, mystery & detective, general"],
    "scifi": ["science fiction", "sci-fi", "space opera", "dystopia", "post-apocalyptic fiction", "fiction, science fiction, general", "fiction, science fiction, hard science fiction"],
    "horror": ["horror", "psychological horror", "supernatural horror", "ghost stories", "zombies", "fiction, horror", "horror tales", "horror stories"],
    "adventure": ["adventure", "action", "action-adventure", "quests", "exploration", "fiction, action & adventure"],
    "fiction": ["fiction", "literary fiction", "general fiction", "contemporary fiction", "domestic fiction", "fiction, family life", "fiction, historical", "fiction, psychological"],
    "historical": ["historical", "historical fiction", "historical romance", "period drama", "fiction, historical, general"],
    "biography": ["biography", "memoir", "autobiography", "personal memoirs", "biography & autobiography", "biography & autobiography / social scientists & psychologists"],
    "self_help": ["self-help", "personal development", "self-improvement", "motivational"],
    "poetry": ["poetry", "poems", "verse", "free verse poetry"],
    "graphic_novel": ["graphic novel", "comics", "manga", "illustrated books", "cartoons and comics", "comics & graphic novels"],
    "nonfiction": ["nonfiction", "history", "essays", "psychology / history", "comic books, strips, etc., history and criticism"],
    "ya": ["young adult", "ya", "teen fiction", "juvenile fiction", "fiction, coming of age"],
    "children": ["children", "kids", "middle grade", "picture book", "juvenile literature", "children's fiction"],
    "classics": ["classics", "classic", "literary classics", "classic literature"],
    "dystopian": ["dystopia", "post-apocalyptic", "future", "totalitarianism"],
    "social_issues": ["social issues", "race relations", "gender roles", "class differences", "interracial marriage", "social themes"],
    "war_military": ["war", "military", "world war", "historical war", "dwarfs", "award:newbery_award"],
    "health": ["nutrition", "birth control", "diet fads", "feeding behavior", "natural foods", "nutrition and dietetics"],
    "translations": ["tłumaczenia polskie", "translations into Spanish", "roman anglais", "powieść autobiograficzna amerykańska"],
}
