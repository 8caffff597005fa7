"""Patterns, word lists and tables that results depend on."""

# Fixed values, as plain text in their natural order.
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-]+(?:\.[a-zA-Z0-9-]+)*"
PHONE = (
    r"(?:(?:\+|00)[1-9][0-9]{0,2}[\s\-/]*(?:\(0\))?[\s\-/]*|0)"
    r"[\s\-/]*\d{2,5}[\s\-/]*\d{2,4}[\s\-/]*\d{2,4}(?:[\s\-/]*\d{2,6})?"
)
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "gif", "svg", "webp", "ico", "bmp", "tiff")
PLACEHOLDER_DOMAINS = (
    "example.com", "example.org", "example.net", "domain.com", "yourdomain.com", "email.com", "mysite.com", "yoursite.com",
    "yourwebsite.com", "mywebsite.com", "placeholder.com", "provider.com",
)
PREFERRED_PREFIXES = (
    "info", "careers", "jobs", "hr", "recruitment", "hiring", "apply", "contact", "hello", "team", "support", "work", "talent",
    "join", "cv", "resume", "career", "office", "admin", "mail", "business", "enquiry", "enquiries", "inquiry", "inquiries", "recruit",
)
GENERIC_LOCALS = (
    "info", "contact", "hello", "mail", "admin", "support", "office", "team", "careers", "jobs", "hr", "sales", "enquiry",
    "enquiries", "inquiry", "inquiries", "recruit", "recruitment", "noreply", "no-reply", "newsletter", "marketing", "billing",
    "press", "media", "partner", "partners", "service", "services", "customerservice", "customersupport", "feedback", "commercial",
)
JUNK_PATTERNS = (
    "sentry", "tracking", "analytics", "noreply", "no-reply", "mailer-daemon", "postmaster", "npm@", "lodash@", "react@", "core-js",
    "intl-segmenter", "focus-within", "rspack@", "slick-carousel", "whatwg-fetch", "webpack", "example.com", "domain.com",
    "yourdomain.com", "mijnwebsite.com", "provider.com", "@mysite.com", "@yoursite.com", "@yourwebsite.com", "@mywebsite.com",
    "@placeholder.com", "@example.org", "@example.net", "@yourcompany.com", "@mycompany.com", "^[a-f0-9]{32}@", "^[a-f0-9]{8,}@",
)
#: Country code -> least digits of the number after it.
COUNTRY_DIGITS = {
    "1": 10, "52": 10, "49": 10, "44": 9, "33": 9, "34": 9, "39": 9, "31": 9, "32": 9, "41": 9, "43": 9, "48": 9, "46": 9, "47": 8,
    "45": 8, "358": 9, "351": 9, "353": 9, "30": 10, "36": 9, "40": 9, "420": 9, "421": 9, "212": 9, "213": 9, "966": 9, "971": 9,
    "974": 8, "965": 8, "968": 8, "973": 8, "972": 9, "90": 10, "20": 9, "91": 10, "61": 9, "64": 9, "65": 8, "60": 9, "62": 9,
    "63": 10, "66": 9, "84": 9, "81": 10, "82": 9, "86": 11, "852": 8, "886": 9, "27": 9, "234": 9, "254": 9, "55": 10, "54": 10,
    "56": 9, "57": 10,
}
CONTACT_PATHS = (
    "", "/contact", "/contact-us", "/contactez-nous", "/contacts", "/about", "/about-us", "/a-propos", "/qui-sommes-nous", "/team",
    "/our-team", "/meet-the-team", "/notre-equipe", "/leadership", "/management", "/founders", "/board", "/executive", "/company",
    "/uber-uns", "/ueber-uns", "/unternehmen", "/impressum", "/imprint", "/legal-notice", "/legal", "/careers", "/jobs", "/kontakt",
    "/kontaktformular", "/contact.html", "/impressum.html", "/contacto", "/get-in-touch",
)
CONTACT_HINTS = (
    "contact", "kontakt", "impressum", "imprint", "about", "team", "leadership", "management", "founders", "get in touch", "reach us",
    "write us", "email", "mail", "contactez", "nous contacter", "a-propos", "qui sommes", "uber uns", "kontaktformular",
)
#: (rank, pattern), the lowest rank the most senior; the first that is found counts.
TITLES = (
    (10, r"ceo|chief\s*executive\s*officer|geschäftsführer|geschaeftsfuehrer|président|présidente|directeur\s*général|directrice\s*générale"),
    (20, r"founder|co-founder|cofounder|gründer|mitgründer|fondateur|fondatrice|cofondateur|cofondatrice"),
    (30, r"managing\s*director|geschäftsleitung|standortleiter"),
    (40, r"owner|inhaber|eigentümer|president|präsident"),
    (45, r"gérant|gérante"),
    (50, r"partner|teilhaber|gesellschafter|associé|associée"),
    (60, r"cto|chief\s*technology\s*officer|technikvorstand|cfo|chief\s*financial\s*officer"),
    (70, r"director|leitung|abteilungsleiter|bereichsleiter|directeur|directrice|chef\s*de|responsable\s*de"),
    (80, r"head\s*of|vp\s*of|vice\s*president|vize"),
    (90, r"manager|teamlead|team\s*lead|senior|responsable"),
)
PERSON_NAME = r"[A-ZÄÖÜÀÂÆÇÈÉÊËÌÍÎÏÑÒÓÔŒÙÚÛÜŸ][a-zäöüßàâæçèéêëìíîïñòóôœùúûüÿ]+(?:-[A-ZÄÖÜÀÂÆÇÈÉÊËÌÍÎÏÑÒÓÔŒÙÚÛÜŸ][a-zäöüßàâæçèéêëìíîïñòóôœùúûüÿ]+)?\s+[A-ZÄÖÜÀÂÆÇÈÉÊËÌÍÎÏÑÒÓÔŒÙÚÛÜŸ][a-zäöüßàâæçèéêëìíîïñòóôœùúûüÿ]+(?:-[A-ZÄÖÜÀÂÆÇÈÉÊËÌÍÎÏÑÒÓÔŒÙÚÛÜŸ][a-zäöüßàâæçèéêëìíîïñòóôœùúûüÿ]+)?"
NON_NAMES = (
    "about", "contact", "impressum", "imprint", "privacy", "legal", "search", "careers", "jobs", "apply", "team", "leadership",
    "management", "services", "products", "solutions", "portfolio", "projects", "english", "german", "french", "spanish", "deutsch",
    "englisch", "email", "phone", "address", "location", "opening", "hours", "social", "media", "facebook", "twitter", "linkedin",
    "instagram", "download", "subscribe", "newsletter", "sign", "login", "register", "home", "menu", "navigation", "footer", "header",
    "sidebar", "powered", "copyright", "all", "rights", "reserved", "accueil", "contactez", "mentions", "legales", "conditions",
    "confidentialité", "politique", "charte", "données", "personnelles", "cookies", "mohammed", "ahmed", "ali", "hassan", "hussein",
    "ibrahim", "about us", "view all", "our team", "meet the team", "our story", "learn more", "read more", "get in touch",
    "our mission", "our vision", "our values", "our clients", "our partners", "our work", "our approach", "our people", "our company",
    "our products", "our services", "team member", "get started", "sign up", "our firm", "our family", "meet our team",
    "our leadership", "our phoenix", "our solutions",
)
NON_NAME_WORDS = (
    "about", "us", "view", "all", "our", "team", "story", "learn", "more", "read", "get", "touch", "mission", "vision", "values",
    "clients", "partners", "work", "approach", "people", "leadership", "company", "products", "services", "contact", "careers", "jobs",
    "login", "sign", "register", "news", "blog", "portfolio", "projects", "solutions", "manufacturing", "engineering", "department",
    "division", "gallery", "menu", "home", "join", "apply", "privacy", "terms", "cookies", "search", "navigation", "footer", "header",
    "powered", "copyright", "institute", "university", "college", "school", "center", "centre", "foundation", "association", "council",
    "society", "authority", "ministry", "laboratory", "corporate", "office", "group", "limited", "gmbh", "llc", "inc", "ltd", "plc",
    "systems", "technologies", "technology", "software", "consulting", "research", "state", "additive", "catechetical", "phoenix",
    "global", "international", "digital", "cloud", "network", "data",
)
#: Hosts that are no company's own, of geo elements and of search results.
GEO_HOSTS = ("facebook.com", "instagram.com", "linkedin.com", "twitter.com", "x.com", "youtube.com", "tiktok.com", "yelp.com", "foursquare.com", "google.com")
SEARCH_HOSTS = ("google.com", "youtube.com", "facebook.com", "instagram.com", "twitter.com", "linkedin.com", "pinterest.com", "yelp.com", "maps.google.com", "duckduckgo.com")
#: Links of saved result pages: address and title.
RESULT_HEADING = r"""<h3[^>]*>\s*<a[^>]+href=["']([^"']+)["'][^>]*>(.*?)</a>\s*</h3>"""
RESULT_LINK = r"""<a[^>]+class=["'][^"']*result__a[^"']*["'][^>]+href=["']([^"']+)["'][^>]*>(.*?)</a>"""
KNOWN_PROVIDERS = (
    "gmail.com", "googlemail.com", "outlook.com", "hotmail.com", "live.com", "msn.com", "yahoo.com", "ymail.com", "aol.com",
    "icloud.com", "me.com", "protonmail.com", "proton.me", "zoho.com", "mail.com", "gmx.com", "hey.com", "fastmail.com",
    "outlook.fr", "hotmail.fr",
)
POI_TYPES = (
    "university", "hotel", "restaurant", "museum", "school", "hospital", "church", "stadium", "theatre", "attraction", "yes",
    "building", "cafe", "pub", "shop", "office",
)
BUSINESS_KEYS = ("office", "shop", "amenity", "leisure", "sport", "tourism", "healthcare")
VALUE_KEYS = ("amenity", "shop", "office", "leisure", "sport", "healthcare", "tourism", "catering")
#: Strict matches of a group below which loose ones are taken, and found elements below which all named ones are.
RELAXED_MIN = 50
CATCH_ALL_MIN = 100
# Tags of map elements and words of company names for each niche, in their natural order.
NICHE_TAGS = {
    "fitness": ("leisure=fitness_centre", "leisure=sports_centre", "amenity=gym", "sport=fitness"),
    "gym": ("leisure=fitness_centre", "amenity=gym"),
    "fitness gym": ("leisure=fitness_centre", "amenity=gym", "leisure=sports_centre"),
    "gymnasium": ("leisure=fitness_centre", "amenity=gym"),
    "yoga": ("leisure=fitness_centre", "amenity=gym", "leisure=yoga"),
    "yoga studio": ("leisure=fitness_centre", "amenity=gym"),
    "pilates": ("leisure=fitness_centre", "amenity=gym"),
    "crossfit": ("leisure=fitness_centre", "sport=crossfit"),
    "personal trainer": ("leisure=fitness_centre", "sport=personal_trainer"),
    "restaurant": ("amenity=restaurant", "amenity=fast_food", "amenity=food_court"),
    "cafe": ("amenity=cafe", "amenity=coffee_shop", "shop=coffee"),
    "coffee shop": ("amenity=cafe", "shop=coffee"),
    "bakery": ("shop=bakery", "amenity=bakery"),
    "pizza": ("amenity=restaurant", "amenity=fast_food", "cuisine=pizza"),
    "bar": ("amenity=bar", "amenity=pub", "amenity=nightclub"),
    "pub": ("amenity=pub", "amenity=bar"),
    "fast food": ("amenity=fast_food",),
    "ice cream": ("amenity=ice_cream", "shop=ice_cream"),
    "dentist": ("amenity=dentist", "healthcare=dentist"),
    "doctor": ("amenity=doctors", "healthcare=doctor"),
    "clinic": ("amenity=clinic", "healthcare=clinic"),
    "hospital": ("amenity=hospital", "healthcare=hospital"),
    "pharmacy": ("shop=chemist", "amenity=pharmacy"),
    "optician": ("shop=optician", "healthcare=optometrist"),
    "physiotherapist": ("healthcare=physiotherapist", "amenity=physiotherapist"),
    "veterinary": ("amenity=veterinary", "healthcare=veterinary"),
    "beauty salon": ("shop=hairdresser", "shop=beauty", "shop=cosmetics"),
    "hairdresser": ("shop=hairdresser", "shop=barber"),
    "barber": ("shop=barber", "shop=hairdresser"),
    "nail salon": ("shop=beauty", "shop=cosmetics"),
    "spa": ("shop=beauty", "leisure=spa", "amenity=spa"),
    "massage": ("shop=massage", "leisure=massage", "amenity=massage"),
    "hotel": ("tourism=hotel", "tourism=guest_house", "tourism=hostel", "tourism=motel"),
    "hostel": ("tourism=hostel",),
    "motel": ("tourism=motel",),
    "guest house": ("tourism=guest_house",),
    "bed and breakfast": ("tourism=guest_house", "tourism=bed_and_breakfast"),
    "apartment": ("tourism=apartment", "tourism=apart_hotel"),
    "real estate": ("office=real_estate", "office=estate_agent", "shop=estate_agent"),
    "real estate agent": ("office=real_estate", "office=estate_agent"),
    "property": ("office=real_estate", "office=property_management"),
    "property management": ("office=property_management",),
    "architect": ("office=architect", "shop=architect"),
    "car rental": ("amenity=car_rental", "shop=car_rental"),
    "car dealer": ("shop=car", "shop=car_dealer"),
    "car repair": ("shop=car_repair", "amenity=car_repair"),
    "auto repair": ("shop=car_repair", "amenity=car_repair"),
    "mechanic": ("shop=car_repair", "amenity=car_repair"),
    "car wash": ("amenity=car_wash", "shop=car_wash"),
    "gas station": ("amenity=fuel", "shop=fuel"),
    "petrol station": ("amenity=fuel",),
    "parking": ("amenity=parking",),
    "taxi": ("amenity=taxi", "shop=taxi"),
    "it": ("office=it", "office=software", "office=technology", "office=telecommunication", "office=web_design", "office=research"),
    "it company": ("office=it", "office=software", "office=technology"),
    "it services": ("office=it", "office=software", "office=technology"),
    "it consulting": ("office=it", "office=software", "office=consulting"),
    "tech": ("office=technology", "office=it", "office=software"),
    "tech company": ("office=technology", "office=it", "office=software"),
    "technology": ("office=technology", "office=it", "office=software"),
    "technology company": ("office=technology", "office=it", "office=software"),
    "software": ("office=software", "office=it"),
    "software company": ("office=software", "office=it"),
    "software development": ("office=software", "office=it"),
    "software developer": ("office=software", "office=it"),
    "web development": ("office=software", "office=web_design", "office=it"),
    "web design": ("office=web_design", "office=software", "office=it"),
    "web developer": ("office=web_design", "office=software", "office=it"),
    "app development": ("office=software", "office=it"),
    "mobile development": ("office=software", "office=it"),
    "programming": ("office=software", "office=it"),
    "developer": ("office=software", "office=it"),
    "computer": ("shop=computer", "office=it", "shop=electronics"),
    "computer services": ("office=it", "shop=computer"),
    "computer repair": ("shop=computer", "shop=electronics"),
    "cybersecurity": ("office=it", "office=security"),
    "cloud": ("office=it", "office=software"),
    "cloud computing": ("office=it", "office=software"),
    "data": ("office=it", "office=software"),
    "telecom": ("office=telecommunication", "office=it"),
    "telecommunications": ("office=telecommunication", "office=it"),
    "e-commerce": ("shop=electronics", "office=it", "office=software"),
    "ecommerce": ("shop=electronics", "office=it", "office=software"),
    "startup": ("office=startup", "office=company"),
    "coworking": ("amenity=coworking", "office=coworking"),
    "marketing agency": ("office=marketing", "office=advertising"),
    "advertising": ("office=advertising", "office=marketing"),
    "consulting": ("office=consulting", "office=management_consulting"),
    "law firm": ("office=lawyer", "office=attorney", "office=legal"),
    "lawyer": ("office=lawyer", "office=attorney", "office=legal"),
    "accountant": ("office=accountant", "office=accounting"),
    "insurance": ("office=insurance", "shop=insurance"),
    "bank": ("amenity=bank", "office=bank"),
    "financial": ("office=financial", "office=insurance", "amenity=bank"),
    "recruitment": ("office=recruitment", "office=employment_agency"),
    "employment agency": ("office=employment_agency", "office=recruitment"),
    "school": ("amenity=school", "amenity=college", "amenity=university"),
    "university": ("amenity=university", "amenity=college"),
    "college": ("amenity=college", "amenity=university"),
    "language school": ("amenity=language_school", "office=language_school"),
    "driving school": ("amenity=driving_school",),
    "kindergarten": ("amenity=kindergarten", "amenity=nursery"),
    "tutoring": ("amenity=tutoring", "office=tutoring"),
    "training center": ("amenity=training_center", "office=training"),
    "cinema": ("amenity=cinema", "leisure=cinema"),
    "theatre": ("amenity=theatre", "leisure=theatre"),
    "museum": ("tourism=museum", "amenity=museum"),
    "nightclub": ("amenity=nightclub", "leisure=nightclub"),
    "bowling": ("leisure=bowling_alley", "amenity=bowling_alley"),
    "amusement park": ("leisure=amusement_park", "tourism=theme_park"),
    "supermarket": ("shop=supermarket", "shop=grocery"),
    "grocery": ("shop=grocery", "shop=supermarket", "shop=convenience"),
    "convenience store": ("shop=convenience", "shop=grocery"),
    "clothing store": ("shop=clothes", "shop=fashion"),
    "bookstore": ("shop=books", "shop=stationery"),
    "electronics store": ("shop=electronics", "shop=computer"),
    "furniture store": ("shop=furniture", "shop=home_improvement"),
    "hardware store": ("shop=hardware", "shop=doityourself"),
    "gift shop": ("shop=gift", "shop=novelty"),
    "jewelry": ("shop=jewelry", "shop=watches"),
    "shoe store": ("shop=shoes", "shop=clothes"),
    "sporting goods": ("shop=sports", "shop=outdoor"),
    "department store": ("shop=department_store", "shop=mall"),
    "photographer": ("shop=photographer", "office=photographer"),
    "travel agency": ("shop=travel_agency", "office=travel_agent"),
    "printing": ("shop=copying", "shop=printing"),
    "laundry": ("shop=laundry", "shop=dry_cleaning", "amenity=laundry"),
    "dry cleaning": ("shop=dry_cleaning", "shop=laundry"),
    "moving": ("shop=moving", "office=moving"),
    "electrician": ("office=electrician", "shop=electrician"),
    "plumber": ("office=plumber", "shop=plumber"),
    "logistics": ("office=logistics", "office=transport", "amenity=logistics"),
    "courier": ("office=courier", "amenity=courier"),
    "delivery": ("office=delivery", "amenity=delivery"),
    "freight": ("office=freight", "office=logistics"),
    "warehouse": ("building=warehouse", "office=warehouse"),
    "shipping": ("office=shipping", "office=logistics"),
    "cleaning": ("office=cleaning", "shop=cleaning"),
    "gardening": ("shop=garden_centre", "office=gardening"),
    "landscaping": ("office=landscaping", "office=gardening"),
    "construction": ("office=construction", "building=construction"),
    "contractor": ("office=contractor", "office=construction"),
    "renovation": ("office=renovation", "office=construction"),
    "interior design": ("office=interior_design", "shop=interior_design"),
    "pest control": ("office=pest_control", "shop=pest_control"),
    "security": ("office=security", "shop=security"),
    "event planning": ("office=event_planner", "office=events"),
    "wedding planner": ("office=wedding_planner", "office=event_planner"),
    "catering": ("amenity=catering", "office=catering"),
    "food truck": ("amenity=food_truck", "amenity=fast_food"),
    "party rental": ("shop=party_supplies", "office=party_rental"),
}
NICHE_TERMS = {
    "it": ("tech", "technology", "technologies", "software", "systems", "data", "cyber", "computer", "network", "cloud", "telecom", "programming", "information", "edv", "informatik", "softwarehaus"),
    "it company": ("tech", "software", "systems", "data", "cyber", "computer", "network", "cloud", "programming", "information", "edv", "informatik", "softwarehaus"),
    "it services": ("tech", "software", "systems", "data", "cyber", "computer", "network", "cloud", "programming", "information", "edv", "informatik", "softwarehaus"),
    "software": ("software", "tech", "digital", "systems", "app", "programming"),
    "software company": ("software", "tech", "digital", "systems", "app"),
    "software development": ("software", "tech", "digital", "systems", "app"),
    "tech": ("technology", "tech", "software", "digital"),
    "technology": ("technology", "tech", "software", "digital"),
    "technology company": ("technology", "tech", "software", "digital"),
    "computer": ("computer", "tech", "it", "repair", "services"),
    "web development": ("web", "software", "tech", "digital", "design"),
    "web design": ("web", "design", "digital", "tech"),
    "app development": ("app", "software", "mobile", "tech"),
    "mobile development": ("mobile", "app", "software", "tech"),
    "programming": ("programming", "software", "tech", "code"),
    "developer": ("developer", "software", "tech", "code", "programming"),
    "data": ("data", "analytics", "science", "tech"),
    "cybersecurity": ("cyber", "security", "tech", "it"),
    "cloud": ("cloud", "tech", "software", "it"),
    "cloud computing": ("cloud", "tech", "software", "it"),
    "telecom": ("telecom", "telecommunication", "communication", "network"),
    "telecommunications": ("telecom", "telecommunication", "communication", "network"),
    "e-commerce": ("ecommerce", "e-commerce", "online", "store", "shop", "web"),
    "ecommerce": ("ecommerce", "e-commerce", "online", "store", "shop", "web"),
    "startup": ("ventures", "labs", "capital", "partners", "tech", "software", "digital", "innovation"),
}
CONTACT_COLUMNS = {
    "company_name": "Company Name", "website": "Website", "source": "Source", "phone_number": "Phone Number", "contact_person": "Contact Person",
    "contact_title": "Contact Title", "contact_email": "Contact Email", "founder_source": "Founder Source", "all_emails_found": "All Emails Found",
}
