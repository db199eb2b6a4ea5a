"""Types of a structured document, and the rules that one is checked against. Fixed values."""

from __future__ import annotations

DOCUMENT = """
`$schema` string, identifiers array<struct<identifier:string,identifierType:string>>,
creators array<struct<name:string,givenName:string,familyName:string,nameType:string,affiliation:array<string>,nameIdentifiers:array<struct<nameIdentifier:string,nameIdentifierScheme:string,schemeURI:string>>>>,
titles array<struct<title:string,titleType:string>>, publisher struct<name:string,publisherIdentifier:string,publisherIdentifierScheme:string,schemeURI:string>,
publicationYear bigint, subjects array<struct<subject:string,subjectScheme:string>>, dates array<struct<date:string,dateType:string,dateInformation:string>>,
language string, types struct<resourceType:string,resourceTypeGeneral:string>,
relatedIdentifiers array<struct<relatedIdentifier:string,relatedIdentifierType:string,relationType:string,resourceTypeGeneral:string>>,
sizes array<string>, formats array<string>, version string,
rightsList array<struct<rights:string,rightsUri:string,rightsIdentifier:string,rightsIdentifierScheme:string,schemeUri:string,language:string>>,
descriptions array<struct<description:string,descriptionType:string,language:string>>,
fundingReferences array<struct<funderName:string,funderIdentifier:string,funderIdentifierType:string,schemeUri:string,awardNumber:string,awardTitle:string,awardUri:string>>,
conference struct<conferenceName:string,conferenceLocation:string,conferenceUri:string,conferenceStartDate:string,conferenceEndDate:string,conferenceAcronym:string,conferenceSeries:string>,
posterContent struct<sections:array<struct<sectionTitle:string,sectionContent:string>>>, domain string,
imageCaptions array<struct<captions:array<string>>>, tableCaptions array<struct<captions:array<string>>>
""".replace("\n", " ").strip()

#: What documents without one get as `$schema`; the functions that stamp take another address.
SCHEMA_URL = "urn:document-schema:0.1"

TEXT, FILLED = {"type": "string"}, {"type": "string", "minLength": 1}
YEAR = {"type": "integer", "minimum": 1900, "maximum": 2100}


def one_of(*values: str) -> dict:
    return {"type": "string", "enum": list(values)}


def record(required: str = "", **properties: dict) -> dict:
    return {"type": "object", "properties": properties} | ({"required": required.split()} if required else {})


def many(items: dict, least: int = 0) -> dict:
    return {"type": "array", "items": items} | ({"minItems": least} if least else {})


#: What an extracted document should look like. Checks go in the order in which the rules stand here.
RULES = record(
    creators=many(record("name", name=FILLED, givenName=FILLED, familyName=FILLED, nameType=one_of("Personal", "Organizational"), affiliation=many(FILLED)), 1),
    titles=many(record("title", title=FILLED), 1),
    publicationYear=YEAR,
    subjects=many(record("subject", subject=FILLED), 1),
    descriptions=many(record("descriptionType description", description=FILLED, descriptionType=one_of("Abstract", "Methods", "SeriesInformation", "TableOfContents", "TechnicalInfo", "Other")), 1),
    publisher=record("name", name=FILLED),
    conference=record("conferenceName conferenceYear", conferenceName=FILLED, conferenceYear=YEAR, conferenceLocation=FILLED, conferenceStartDate=TEXT, conferenceEndDate=TEXT, conferenceAcronym=TEXT),
    rightsList=many(record("rights", rights=FILLED, rightsUri=TEXT, rightsIdentifier=TEXT), 1),
    formats=many(FILLED, 1),
    content=record(sections=many(record(sectionTitle=TEXT, sectionContent=TEXT)), unstructuredContent=TEXT),
    imageCaptions=many(record("caption", id=TEXT, caption=FILLED)),
    tableCaptions=many(record("caption", id=TEXT, caption=FILLED)),
    required="creators titles publicationYear subjects descriptions publisher conference formats",
)

#: Fields that are filled if they are absent, in this order.
DEFAULTS = {
    **dict.fromkeys("doi prefix suffix".split(), ""),
    **{k: [] for k in "identifiers alternateIdentifiers creators titles subjects dates relatedIdentifiers sizes formats rightsList descriptions fundingReferences ethicsApprovals imageCaptions tableCaptions".split()},
    **{k: {} for k in "publisher types conference".split()},
    "posterContent": {"sections": []},
    "publicationYear": None,
    "language": "en",
    "version": "",
    "domain": "",
}

#: Columns of the metadata table, in order.
METADATA = """posterId doi identifiers creators publisher publicationYear subjects language relatedIdentifiers size format version license
fundingReferences conferenceName conferenceLocation conferenceUri conferenceIdentifier conferenceIdentifierType conferenceYear conferenceStartDate
conferenceEndDate conferenceAcronym conferenceSeries posterContent tableCaptions imageCaptions domain""".split()
