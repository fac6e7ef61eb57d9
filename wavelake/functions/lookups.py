"""Fixed values of the sound formats, as plain lists and as small DataFrames for lookup joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Sample formats as (name, bits, is_pcm, is_float).
FORMATS = [("u8", 8, True, False), ("s8", 8, True, False), ("s16", 16, True, False), ("s24", 24, True, False), ("s32", 32, True, False), ("f32", 32, True, True), ("f64", 64, True, True), ("dsd1", 1, False, False), ("opaque", 8, False, False)]

# The tag vocabulary, in order.
TAGS = "title artist album albumartist date tracknumber tracktotal discnumber disctotal genre composer performer comment copyright encoder isrc language organization lyrics bpm".split()

# Container spellings of tags.
VORBIS_FIELDS = {"TITLE": "title", "ARTIST": "artist", "ALBUM": "album", "ALBUMARTIST": "albumartist", "ALBUM ARTIST": "albumartist", "DATE": "date", "YEAR": "date", "TRACKNUMBER": "tracknumber", "TRACKTOTAL": "tracktotal", "TOTALTRACKS": "tracktotal", "DISCNUMBER": "discnumber", "DISCTOTAL": "disctotal", "TOTALDISCS": "disctotal", "GENRE": "genre", "COMPOSER": "composer", "PERFORMER": "performer", "COPYRIGHT": "copyright", "DESCRIPTION": "comment", "COMMENT": "comment", "ORGANIZATION": "organization", "LABEL": "organization", "PUBLISHER": "organization", "ENCODER": "encoder", "ISRC": "isrc", "LYRICS": "lyrics", "UNSYNCEDLYRICS": "lyrics", "BPM": "bpm", "LANGUAGE": "language"}
ID3_FRAMES = {"TIT2": "title", "TT2": "title", "TPE1": "artist", "TP1": "artist", "TALB": "album", "TAL": "album", "TPE2": "albumartist", "TP2": "albumartist", "TDRC": "date", "TYER": "date", "TYE": "date", "TRCK": "tracknumber", "TRK": "tracknumber", "TPOS": "discnumber", "TPA": "discnumber", "TCON": "genre", "TCO": "genre", "TCOM": "composer", "TCM": "composer", "TPE3": "performer", "TP3": "performer", "TPE4": "performer", "TP4": "performer", "COMM": "comment", "COM": "comment", "TCOP": "copyright", "TCR": "copyright", "TSSE": "encoder", "TSS": "encoder", "TSRC": "isrc", "TRC": "isrc", "TLAN": "language", "TLA": "language", "TPUB": "organization", "TPB": "organization", "USLT": "lyrics", "ULT": "lyrics", "TBPM": "bpm", "TBP": "bpm"}
RIFF_FIELDS = {"INAM": "title", "IART": "artist", "IPRD": "album", "ICRD": "date", "IDIT": "date", "ITRK": "tracknumber", "IPRT": "tracknumber", "IGNR": "genre", "IMUS": "composer", "ISTR": "performer", "ICMT": "comment", "ISBJ": "comment", "ICOP": "copyright", "ISFT": "encoder", "ILNG": "language", "IPUB": "organization"}

# The ID3v1 genres, by number.
GENRES = """Blues|Classic Rock|Country|Dance|Disco|Funk|Grunge|Hip-Hop|Jazz|Metal|New Age|Oldies|Other|Pop|R&B|Rap|Reggae|Rock|Techno|Industrial|Alternative|Ska|Death Metal|Pranks|Soundtrack|Euro-Techno|Ambient|Trip-Hop|Vocal|Jazz+Funk|Fusion|Trance|Classical|Instrumental|Acid|House|Game|Sound Clip|Gospel|Noise|Alt. Rock|Bass|Soul|Punk|Space|Meditative|Instrumental Pop|Instrumental Rock|Ethnic|Gothic|Darkwave|Techno-Industrial|Electronic|Pop-Folk|Eurodance|Dream|Southern Rock|Comedy|Cult|Gangsta Rap|Top 40|Christian Rap|Pop/Funk|Jungle|Native American|Cabaret|New Wave|Psychedelic|Rave|Showtunes|Trailer|Lo-Fi|Tribal|Acid Punk|Acid Jazz|Polka|Retro|Musical|Rock & Roll|Hard Rock|Folk|Folk-Rock|National Folk|Swing|Fast-Fusion|Bebop|Latin|Revival|Celtic|Bluegrass|Avantgarde|Gothic Rock|Progressive Rock|Psychedelic Rock|Symphonic Rock|Slow Rock|Big Band|Chorus|Easy Listening|Acoustic|Humour|Speech|Chanson|Opera|Chamber Music|Sonata|Symphony|Booty Bass|Primus|Porn Groove|Satire|Slow Jam|Club|Tango|Samba|Folklore|Ballad|Power Ballad|Rhythmic Soul|Freestyle|Duet|Punk Rock|Drum Solo|A Cappella|Euro-House|Dance Hall|Goa|Drum & Bass|Club-House|Hardcore|Terror|Indie|BritPop|Afro-Punk|Polsk Punk|Beat|Christian Gangsta Rap|Heavy Metal|Black Metal|Crossover|Contemporary Christian|Christian Rock|Merengue|Salsa|Thrash Metal|Anime|JPop|Synthpop|Abstract|Art Rock|Baroque|Bhangra|Big Beat|Breakbeat|Chillout|Downtempo|Dub|EBM|Eclectic|Electro|Electroclash|Emo|Experimental|Garage|Global|IDM|Illbient|Industro-Goth|Jam Band|Krautrock|Leftfield|Lounge|Math Rock|New Romantic|Nu-Breakz|Post-Punk|Post-Rock|Psytrance|Shoegaze|Space Rock|Trop Rock|World Music|Neoclassical|Audiobook|Audio Theatre|Neue Deutsche Welle|Podcast|Indie Rock|G-Funk|Dubstep|Garage Rock|Psybient""".split("|")

# IMA ADPCM steps and index moves.
IMA_STEPS = [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767]
IMA_MOVES = [-1, -1, -1, -1, 2, 4, 6, 8]

# MPEG kbit/s by (MPEG-1?, layer) and bitrate index; Hz by version and rate index.
MPEG_BITRATES = {
    (1, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (2, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
MPEG_RATES = {1: [44100, 48000, 32000], 2: [22050, 24000, 16000], 25: [11025, 12000, 8000]}

# Default channel masks of 1 to 8 channels, and the speakers' short names by bit.
DEFAULT_MASKS = [0x4, 0x3, 0x7, 0x33, 0x37, 0x3F, 0x70F, 0x63F]
SPEAKERS = "FL FR FC LFE BL BR FLC FRC BC SL SR TC TFL TFC TFR TBL TBC TBR".split()

# File signatures as (codec, order, offset, hex).
MAGICS = [("wav", 0, 0, "52494646"), ("wav", 0, 8, "57415645"), ("aiff", 1, 0, "464F524D"), ("aiff", 1, 8, "41494646"), ("aiff", 1, 8, "41494643"), ("flac", 2, 0, "664C6143"), ("ogg-flac", 3, 0, "4F676753"), ("vorbis", 5, 0, "4F676753"), ("opus", 6, 0, "4F676753")]


# Text chunks of AIFF, and the seven default MS ADPCM coefficient pairs and its delta factors.
AIFF_FIELDS = {"NAME": "title", "AUTH": "artist", "(c) ": "copyright", "ANNO": "comment"}
MS_PAIRS = [(256, 0), (512, -256), (0, 0), (192, 64), (240, 0), (460, -208), (392, -232)]
MS_FACTORS = [230, 230, 230, 230, 307, 409, 512, 614, 768, 614, 512, 409, 307, 230, 230, 230]

# Codings as (name, is_pcm, format that it decodes to).
CODINGS = [("pcm", True, None), ("ulaw", False, "s16"), ("alaw", False, "s16"), ("ima-wav", False, "s16"), ("ima-qt", False, "s16"), ("ms-adpcm", False, "s16"), ("flac", False, None)]


def table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql_values(rows: list[tuple], *names: str) -> str:
    """The same rows as a VALUES list for SQL."""
    cell = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") AS t({', '.join(names)})"
