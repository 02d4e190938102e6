import pytest

from tessera.operators import song_titles

UPLOADS = "id int, title string, channel string, shorts boolean"
# title, channel, shorts; then what must come out
CASES = [
    ("Kanye West - Stronger (Official Music Video)", "KanyeWestVEVO", False, {"artist": "Kanye West", "title": "Stronger", "variant": None, "confidence": 0.8}),
    ("Harder, Better, Faster, Stronger", "Daft Punk - Topic", False, {"artist": "Daft Punk", "title": "Harder, Better, Faster, Stronger", "confidence": 0.8}),
    ("Queen - Bohemian Rhapsody [4K Remaster]", None, False, {"artist": "Queen", "title": "Bohemian Rhapsody"}),
    ("Here Comes The Sun - Remastered 2009", "The Beatles - Topic", False, {"artist": "The Beatles", "title": "Here Comes The Sun"}),
    ("Levels - Radio Edit", "Avicii - Topic", False, {"title": "Levels"}),
    ('Shallow - From "A Star Is Born" Soundtrack', "Lady Gaga - Topic", False, {"title": "Shallow"}),
    ("Star Wars: Main Title", "John Williams - Topic", False, {"title": "Star Wars: Main Title"}),
    ("Mark Ronson - Uptown Funk (Official Video) ft. Bruno Mars", "Mark Ronson", False, {"artist": "Mark Ronson", "title": "Uptown Funk", "featured": ["Bruno Mars"]}),
    ("Calvin Harris ft. Rihanna - This Is What You Came For", None, False, {"artist": "Calvin Harris", "title": "This Is What You Came For", "featured": ["Rihanna"]}),
    ("Kanye West - Gold Digger (feat. Jamie Foxx)", None, False, {"artist": "Kanye West", "title": "Gold Digger", "featured": ["Jamie Foxx"]}),
    ("Drake - Nice For What (prod. by Murda Beatz)", None, False, {"title": "Nice For What"}),
    ("Lil Nas X x Billy Ray Cyrus - Old Town Road", None, False, {"artist": "Lil Nas X x Billy Ray Cyrus", "title": "Old Town Road", "names": ["Lil Nas X", "Billy Ray Cyrus"]}),
    ("Simon & Garfunkel - The Boxer (Audio)", None, False, {"artist": "Simon & Garfunkel", "title": "The Boxer", "names": ["Simon", "Garfunkel"]}),
    ("Dido - Thank You (Lyrics)", None, False, {"artist": "Dido", "title": "Thank You"}),
    ("Avicii - Levels (Official Lyric Video)", None, False, {"artist": "Avicii", "title": "Levels"}),
    ("Beyoncé - BREAK MY SOUL (Official Visualizer)", None, False, {"artist": "Beyoncé", "title": "BREAK MY SOUL"}),
    ("Kanye West - Stronger | Official Video", None, False, {"artist": "Kanye West", "title": "Stronger"}),
    ("Shakira - Hips Don't Lie (Video Oficial)", None, False, {"artist": "Shakira", "title": "Hips Don't Lie"}),
    ("Anitta - Envolver (Legendado)", None, False, {"artist": "Anitta", "title": "Envolver"}),
    ("Queen - Bohemian Rhapsody (Live at Wembley)", None, False, {"artist": "Queen", "title": "Bohemian Rhapsody", "variant": "live"}),
    ("Dua Lipa - Levitating (DaBaby Remix)", None, False, {"artist": "Dua Lipa", "title": "Levitating", "variant": "remix", "remixer": "DaBaby"}),
    ("SZA - Kill Bill (sped up)", None, False, {"title": "Kill Bill", "variant": "sped-up"}),
    ("Kanye West - Stronger (slowed + reverb)", None, False, {"variant": "slowed"}),
    ("Hurt (Acoustic Cover)", None, False, {"variant": "cover"}),
    ("Oasis - Live Forever", None, False, {"artist": "Oasis", "title": "Live Forever", "variant": None}),
    ("Blinding Lights | The Weeknd", "The Weeknd", False, {"artist": "The Weeknd", "title": "Blinding Lights", "has": "swapped"}),
    ("BTS (방탄소년단) 'Dynamite' Official MV", "HYBE LABELS", False, {"artist": "BTS", "title": "Dynamite", "aliases": ["방탄소년단"]}),
    ("【MV】YOASOBI「アイドル」", "Ayase / YOASOBI", False, {"artist": "YOASOBI", "title": "アイドル"}),
    ("米津玄師 MV「Lemon」", "米津玄師", False, {"artist": "米津玄師", "title": "Lemon", "has": "channel-match"}),
    ("周杰倫 Jay Chou【告白氣球】", "周杰倫 Jay Chou", False, {"artist": "周杰倫", "title": "告白氣球", "aliases": ["Jay Chou"]}),
    ("Kanye West - Stronger REACTION!!", "Reacts Daily", False, {"title": "Stronger", "has": "reaction", "below": 0.3}),
    ('[FREE] Kanye West Type Beat - "Stronger"', None, False, {"has": "type-beat", "below": 0.3}),
    ("Kanye West - Stronger (1 Hour Loop)", None, False, {"title": "Stronger", "below": 0.3}),
    ("Daft Punk - Discovery (Full Album)", None, False, {"below": 0.3}),
    ("Kanye West - Stronger", None, False, {"confidence": 0.5}),
    ("Kanye West - Stronger", None, True, {"confidence": 0.35, "has": "shorts"}),
    ("Kanye West - Stronger #shorts #fyp", None, False, {"title": "Stronger", "has": "shorts", "hashtags": []}),
    ("Stronger", "music fan 2007", False, {"title": "Stronger", "has": "channel-guess", "below": 0.55}),
    ("🔥 Kanye West - Stronger 🔥", None, False, {"artist": "Kanye West", "title": "Stronger"}),
    ("Grandmaster & Melle Mel - White Lines (Don't Don't Do It)", None, False, {"title": "White Lines (Don't Don't Do It)"}),
    ("Adele - Hello #Adele25 #hello", None, False, {"title": "Hello", "hashtags": ["Adele25", "hello"]}),
    ("Nirvana - Smells Like Teen Spirit - Live at Reading", None, False, {"artist": "Nirvana", "title": "Smells Like Teen Spirit", "variant": "live"}),
    ("Hallelujah - violin cover", "Someone", False, {"title": "Hallelujah", "variant": "cover"}),
    (None, None, None, {"artist": "", "title": ""}),
    ("   ", "", False, {"artist": "", "title": ""}),
]


def test_uploads_are_read(spark):
    got = {r.id: r for r in song_titles.read_titles(spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], UPLOADS)).collect()}
    assert len(got) == len(CASES)
    for i, (title, _, _, want) in enumerate(CASES):
        r = got[i].asDict()
        for key, value in want.items():
            if key == "has":
                assert value in r["signals"], (title, r)
            elif key == "below":
                assert r["confidence"] < value, (title, r)
            else:
                assert r[key] == (pytest.approx(value) if key == "confidence" else value), (title, key, r)


def test_typed_texts_are_read(spark):
    cases = [("Stronger by Kanye West", "Kanye West", "Stronger", 0.75), ("Kanye West – Stronger", "Kanye West", "Stronger", 0.8), ("daft punk - one more time", "daft punk", "one more time", 0.8), ('Kanye West "Stronger"', "Kanye West", "Stronger", 0.8), ("kanye west stronger", "", "kanye west stronger", 0.2),
        ("Stand by Me", "", "Stand by Me", 0.2), ("Stand by Me by Ben E. King", "Ben E. King", "Stand by Me", 0.75), ("Umbrella ft. Jay-Z", "", "Umbrella ft. Jay-Z", 0.2), ("Rihanna - Umbrella ft. Jay-Z (Lyrics)", "Rihanna", "Umbrella", 0.8), ("“Hello”", "", "Hello", 0.2), (None, "", "", 0.2)]
    got = {r.id: r for r in song_titles.read_typed(spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "id int, text string")).collect()}
    for i, (text, artist, title, confidence) in enumerate(cases):
        assert (got[i].artist, got[i].title, got[i].confidence) == (artist, title, pytest.approx(confidence)), (text, got[i])
    assert "bare" in got[4].signals and got[8].featured == ["Jay-Z"]


def test_empty_tables(spark):
    assert song_titles.read_titles(spark.createDataFrame([], UPLOADS)).count() == 0
    assert song_titles.read_typed(spark.createDataFrame([], "id int, text string")).count() == 0
