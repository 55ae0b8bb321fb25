"""Names used to detect persons and to replace them. Fixed values."""

#: (gender, script) -> first names
FIRST_NAMES = {
    ("f", "latin"): (
        "Alice", "Amelia", "Andrea", "Barbara", "Caroline", "Catherine", "Charlotte", "Christine", "Claudia",
        "Deborah", "Dorothy", "Elena", "Elizabeth", "Emily", "Emma", "Esther", "Eva", "Frances", "Gabriela",
        "Hannah", "Helen", "Ingrid", "Isabella", "Jennifer", "Jessica", "Julia", "Karen", "Katharina", "Laura",
        "Linda", "Lucia", "Margaret", "Maria", "Marie", "Martha", "Mary", "Monika", "Nancy", "Natalie", "Olivia",
        "Patricia", "Rachel", "Rebecca", "Rosa", "Sabine", "Sandra", "Sarah", "Sofia", "Sophie", "Susan", "Teresa",
        "Ursula", "Valerie", "Victoria"),
    ("m", "latin"): (
        "Albert", "Alexander", "Andrew", "Anthony", "Antonio", "Benjamin", "Carlos", "Charles", "Christopher",
        "Daniel", "David", "Diego", "Dieter", "Edward", "Fernando", "Francisco", "Frank", "George", "Hans",
        "Henry", "Jacques", "James", "Javier", "Jean", "Johannes", "John", "Joseph", "Juan", "Jürgen", "Kenneth",
        "Klaus", "Louis", "Lukas", "Manuel", "Mark", "Matthew", "Michael", "Miguel", "Nicolas", "Oliver", "Pablo",
        "Patrick", "Paul", "Pedro", "Peter", "Philippe", "Pierre", "Richard", "Robert", "Stefan", "Steven",
        "Thomas", "William", "Wolfgang"),
    ("f", "cyrillic"): ("Анна", "Екатерина", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Светлана", "Татьяна", "Юлия"),
    ("m", "cyrillic"): ("Александр", "Алексей", "Андрей", "Борис", "Владимир", "Дмитрий", "Иван", "Николай", "Павел", "Сергей"),
    ("f", "greek"): ("Αικατερίνη", "Βασιλική", "Γεωργία", "Ελένη", "Ιωάννα", "Κωνσταντίνα", "Μαρία", "Σοφία"),
    ("m", "greek"): ("Αλέξανδρος", "Βασίλειος", "Γεώργιος", "Δημήτριος", "Ιωάννης", "Κωνσταντίνος", "Νικόλαος", "Παναγιώτης"),
}

#: script -> family names, from which replacements are taken
FAMILY_NAMES = {
    "latin": (
        "Abbott", "Baker", "Becker", "Bennett", "Bernard", "Carter", "Castillo", "Chapman", "Cooper", "Delgado",
        "Dubois", "Ellis", "Fischer", "Fleming", "Fournier", "Gibson", "Girard", "Hoffmann", "Hunter", "Iglesias",
        "Jensen", "Keller", "Lambert", "Lawson", "Marchand", "Mercer", "Moreau", "Navarro", "Norris", "Ortega",
        "Palmer", "Porter", "Ramsey", "Richter", "Salazar", "Schubert", "Sutton", "Thornton", "Vargas", "Wagner",
        "Walter", "Weaver", "Winkler", "Zimmer"),
    "cyrillic": ("Белов", "Волков", "Громов", "Ершов", "Жуков", "Комаров", "Лебедев", "Морозов", "Орлов", "Соколов"),
    "greek": ("Αγγελής", "Βλάχος", "Δήμου", "Καραγιάννης", "Λάμπρου", "Μακρής", "Νικολάου", "Ράπτης"),
}

#: script -> syllables that make a family name longer when those of the list are taken
SYLLABLES = {
    "latin": ("ba", "del", "fen", "gor", "hil", "kam", "lin", "mar", "nov", "per", "rin", "sol", "tan", "ver", "wes", "zel"),
    "cyrillic": ("ба", "вел", "гор", "дан", "лин", "мар", "нов", "рин", "сол", "тан"),
    "greek": ("βα", "γορ", "δαν", "λιν", "μαρ", "νικ", "ριν", "σολ", "ταν", "φιλ"),
}

#: Forms of address before a family name
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Señora")
