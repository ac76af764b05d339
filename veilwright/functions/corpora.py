"""Our own word lists for the name, address, company and prose strategies.

Fixed values, in alphabetical order: changing a list changes every pseudonym drawn from it.
"""

FIRST_NAMES = (
    "Ada Adele Albert Alice Alma Amos Anita Anna Arno Astrid Aurora Basil Beatrice Bela Bernard Bianca Boris "
    "Bruno Carla Casper Cecil Clara Cora Cyrus Dagmar Damon Daria Delia Doris Edgar Edith Elias Ella Elmar Emil "
    "Emma Enid Erica Esther Ethan Eva Felix Fiona Flora Frida Gerda Gideon Gloria Greta Gustav Hanna Harald "
    "Hazel Hector Helga Henry Hilda Hugo Ida Ilona Ines Ingrid Irene Iris Ivan Ivy Jana Jasper Joan Jonas Judith "
    "Julian Kara Karl Katja Klara Lara Lars Laura Leon Lena Lily Linus Lotte Lucas Magnus Mara Marta Max Mila "
    "Mona Nadia Nora Olga Oscar Otto Paula Peter Petra Quentin Ralph Rita Rosa Ruben Ruth Sara Selma Simon "
    "Sofia Stella Thea Theo Tilda Ulla Ursula Vera Victor Viola Walter Wanda Willa Xenia Yara Yvonne Zelda Zora"
).split()

LAST_NAMES = (
    "Abbott Ackerman Albrecht Alder Ames Archer Arnold Ashby Bader Baker Barlow Bauer Becker Bellamy Berger "
    "Birch Blake Bolton Brandt Brook Buchanan Burke Calder Carver Castle Cole Conrad Cooper Crane Dale Dalton "
    "Decker Dietrich Drake Eaton Ebert Elder Ellis Engel Falk Farrell Fischer Fletcher Foster Frank Frost Garner "
    "Geller Gibson Graf Granger Hale Hammond Hardy Hartmann Hayes Heller Hollis Holt Huber Hunter Irving Jansen "
    "Jarvis Keller Kemp Kirsch Knight Kraft Lambert Lang Larkin Lindner Lowell Mason Mercer Meyer Miller Monroe "
    "Moss Nash Neumann Norris Oakley Osborne Palmer Parker Pfeiffer Pierce Porter Quinn Radley Reeves Richter "
    "Roth Rowan Sawyer Schiller Schneider Sharp Shelby Slater Sommer Stein Stone Sutton Tanner Thorne Tucker "
    "Ulrich Vance Vogel Wagner Walker Weber Weston Whitaker Winter Wolf York Zeller Ziegler"
).split()

JOB_LEVELS = "Associate Chief Deputy Junior Lead Principal Regional Senior Staff".split()
JOB_FIELDS = (
    "Accounts Billing Brand Claims Compliance Customer Data Delivery Design Facilities Finance Fleet Inventory "
    "Logistics Marketing Operations Payroll Product Quality Records Research Safety Sales Security Supply Support "
    "Training"
).split()
JOB_ROLES = "Administrator Advisor Analyst Architect Assistant Clerk Coordinator Engineer Manager Officer Planner Specialist".split()

STREET_STEMS = (
    "Alder Apple Bank Beacon Birch Bridge Brook Canal Cedar Chapel Cherry Church Clover College Copper Elm Ferry "
    "Field Forest Garden Glen Grove Harbor Heron Hill Juniper King Lake Laurel Linden Maple Market Meadow Mill Oak "
    "Orchard Park Pine Pond Poplar Prairie Quarry Ridge River School Spring Station Summit Sunset Valley View Walnut "
    "Willow Windmill"
).split()
STREET_SUFFIXES = (
    "Alley Avenue Bend Boulevard Bypass Circle Close Corner Court Crescent Drive Expressway Gardens Grove Heights "
    "Highway Junction Lane Loop Parkway Path Place Plaza Road Route Square Street Terrace Trail Turnpike Walk Way"
).split()

CITY_STEMS = (
    "Alder Ash Bay Birch Bright Brook Cedar Clear Cold Copper Crystal East Elm Fair Falcon Glen Gold Green Haven "
    "High Iron Kings Lake Lime Long Maple Mill New North Oak Old Pine Port Quarry Red River Rose Salt Sand Silver "
    "South Spring Stone Summer West White Wild Winter Wood"
).split()
CITY_ENDINGS = "borough bridge burg bury dale field ford ham haven mouth port side stead ton view ville wick worth".split()

STATES = (
    "Alabama,Alaska,Arizona,Arkansas,California,Colorado,Connecticut,Delaware,Florida,Georgia,Hawaii,Idaho,"
    "Illinois,Indiana,Iowa,Kansas,Kentucky,Louisiana,Maine,Maryland,Massachusetts,Michigan,Minnesota,Mississippi,"
    "Missouri,Montana,Nebraska,Nevada,New Hampshire,New Jersey,New Mexico,New York,North Carolina,North Dakota,"
    "Ohio,Oklahoma,Oregon,Pennsylvania,Rhode Island,South Carolina,South Dakota,Tennessee,Texas,Utah,Vermont,"
    "Virginia,Washington,West Virginia,Wisconsin,Wyoming"
).split(",")

COUNTRIES = (
    "Albania,Argentina,Australia,Austria,Belgium,Bolivia,Botswana,Brazil,Bulgaria,Cambodia,Canada,Chile,Colombia,"
    "Costa Rica,Croatia,Cyprus,Denmark,Ecuador,Egypt,Estonia,Ethiopia,Fiji,Finland,France,Georgia,Germany,Ghana,"
    "Greece,Guatemala,Hungary,Iceland,India,Indonesia,Ireland,Italy,Jamaica,Japan,Jordan,Kenya,Latvia,Lithuania,"
    "Luxembourg,Malaysia,Malta,Mexico,Mongolia,Morocco,Namibia,Nepal,Netherlands,New Zealand,Norway,Panama,"
    "Paraguay,Peru,Poland,Portugal,Romania,Rwanda,Senegal,Slovakia,Slovenia,South Africa,Spain,Sri Lanka,Sweden,"
    "Switzerland,Tanzania,Thailand,Tunisia,Uganda,United Kingdom,United States,Uruguay,Vietnam,Zambia"
).split(",")

COMPANY_STEMS = (
    "Acorn Amber Anchor Apex Arbor Atlas Aurora Beacon Bluebird Boreal Canyon Cobalt Comet Crescent Delta Ember "
    "Evergreen Falcon Fjord Granite Harbor Heron Horizon Indigo Juniper Keystone Lantern Lighthouse Meridian Mosaic "
    "Nimbus Northwind Onyx Orbit Pinnacle Pioneer Prairie Quartz Raven Redwood Sable Sierra Solstice Summit Tundra "
    "Umber Vertex Willow Zenith Zephyr"
).split()
COMPANY_FIELDS = (
    "Analytics Brewing Builders Capital Catering Ceramics Design Energy Foods Freight Health Instruments Labs "
    "Logistics Marine Media Metals Mills Motors Networks Optics Outfitters Paper Partners Pharma Plastics Press "
    "Robotics Security Software Solar Studios Supply Systems Textiles Tools Travel Ventures Water Works"
).split()
COMPANY_SUFFIXES = "AG Corp GmbH Group Holdings Inc LLC LP Ltd PLC".split()

DOMAIN_SUFFIXES = "biz com info io name net org".split()

PROSE_WORDS = (
    "about above acre after again almost along amber among answer apple around autumn away basket beach because "
    "before behind below beside better between beyond bird boat book both bottle branch bread bridge bright brook "
    "brown build candle careful carry castle chair change cheese circle clear cloud coast color common copper corner "
    "could country cover cross dance daylight deep distant door dream early earth east either empty engine enough "
    "evening every family farmer feather field finger first flower follow forest forward friend garden gather gentle "
    "glass golden grass green harbor harvest heavy hidden hill hollow honest horse hotel house hundred island journey "
    "kettle kitchen ladder lake lantern large later laugh leather lesson letter light linen little lonely machine "
    "maple market meadow middle mirror morning mountain music narrow nearby never night noise north number ocean often "
    "orange orchard other outside over paper path pepper picture pillow planet plenty pocket quick quiet rain rather"
).split()
