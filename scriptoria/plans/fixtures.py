"""Small records of our own for sources that the benchmark tables have no rows for."""

PUBMED = """<?xml version="1.0"?><!DOCTYPE PubmedArticleSet PUBLIC "-//NLM//DTD PubMedArticle, 1st January 2024//EN" "x.dtd"><PubmedArticleSet><PubmedArticle><MedlineCitation><PMID Version="1">31234567</PMID><Article><Journal><JournalIssue><Volume>12</Volume><Issue>3</Issue><PubDate><Year>2021</Year><Month>Mar</Month><Day>9</Day></PubDate></JournalIssue><Title>Journal of Nests</Title><ISOAbbreviation>J Nests</ISOAbbreviation></Journal><ArticleTitle>A <i>rich</i>  title</ArticleTitle><Pagination><MedlinePgn>1-9</MedlinePgn></Pagination><ELocationID EIdType="doi">10.1000/loc</ELocationID><AuthorList><Author><LastName>Berg</LastName><ForeName>Ada</ForeName></Author><Author><CollectiveName>Nest Group</CollectiveName></Author><Author><LastName>Cho</LastName><Initials>M</Initials></Author></AuthorList></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="pubmed">31234567</ArticleId><ArticleId IdType="doi">10.1000/NEST.1</ArticleId></ArticleIdList></PubmedData></PubmedArticle><PubmedArticle><MedlineCitation><PMID>42</PMID><Article><Journal><JournalIssue><PubDate><MedlineDate>1998 Dec-1999 Jan</MedlineDate></PubDate></JournalIssue><Title>Old</Title></Journal><ArticleTitle>Second</ArticleTitle></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>"""
CROSSREF = '{"message":{"DOI":"10.1000/ABC","title":["  Of  birds "],"author":[{"family":"Berg","given":"Ada"},{"name":"Nest Group"},{"given":"Plato"}],"published":{"date-parts":[[2020,13,4]]},"type":"proceedings-article","container-title":["Proc. Nests"],"volume":"7","page":"3-4","publisher":"Press","event":{"name":"Nest Conf"}}}'
ARXIV = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2101.00001v2</id><published>2021-01-05T10:00:00Z</published><title>Deep\n nests</title><author><name>Ada Berg</name></author><author><name>Min Cho</name></author><arxiv:doi xmlns:arxiv="http://arxiv.org/schemas/atom">10.1000/Deep</arxiv:doi></entry></feed>'
RIS = "TY  - JOUR\nTI  - First title\nAU  - Berg, Ada\nAU  - Cho, Min\nPY  - 2020/05/01\nJO  - Nests\nSP  - 10\nEP  - 19\nDO  - https://doi.org/10.1000/RIS\nKW  - birds\nKW  - nests\nUR  - https://pubmed.ncbi.nlm.nih.gov/123/\nER  - \nTY  - CPAPER\nT1  - Second\nAN  - 77\nDB  - PubMed\nER  - \nTY  - JOUR\nAU  - No Title\nER  - \n"
HTML = '<html><head><title>Fallback</title><meta name="citation_title" content="Nests &amp; birds"><meta name="Citation_Author" content="Berg, Ada"><meta name="citation_author" content="Cho, Min"><meta property="citation_doi" content="doi:10.1000/x"><meta name="citation_publication_date" content="2019/04"><link rel="canonical" href="https://example.org/a"></head></html>'
HTML_LD = '<html><head><title>Fallback</title><script type="application/ld+json">{"@type":"ScholarlyArticle","headline":"From data","datePublished":"2018-01-02","author":[{"@type":"Person","name":"Ada Berg"},{"name":"Min Cho"}],"isPartOf":{"name":"J Data"}}</script></head></html>'
