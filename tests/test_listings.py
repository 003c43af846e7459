"""Listings as a stream that is stopped, resumed and fails, and captions fetched beside it."""

from quillsieve.sources import listings
from quillsieve.streaming import runs, state

SIZES = {"a": 7, "b": 1, "c": 4, "empty": 1}


def pages(playlist, token):
    """Pages of two items, one of them without a video on every third page."""
    k = int(token or 0)
    if playlist == "broken" and k == 2:
        raise ConnectionError("gone")
    items = [] if playlist == "empty" else [{"video_id": f"{playlist}-video-{k}", "title": f"t{k}"}, {"video_id": None if k % 3 == 0 else f"{playlist}-other-{k}", "title": "x"}]
    return items, str(k + 1) if k + 1 < SIZES.get(playlist, 9) else None


def wanted(playlists):
    found = []
    for p in playlists:
        token, k = None, 0
        while k == 0 or token:
            try:
                items, token = pages(p, token)
            except ConnectionError as e:
                found.append((p, k, None, None, f"ConnectionError: {e}"))
                break
            found += [(p, k, i, x["video_id"], None) for i, x in enumerate(items) if x["video_id"]]
            k += 1
    return sorted(found, key=repr)


def stream(spark, playlists, size=2):
    spark.dataSource.register(listings.ListingSource)
    options = {"playlists": ",".join(playlists), "fetch": "tests.test_listings:pages", "pages": size, "attempts": 2, "pause": 0.01}
    return spark.readStream.format("playlist_listing").options(**options).load()


def test_a_listing_goes_on_at_its_page(spark, tmp_path):
    playlists, out, mark = ["a", "b", "broken", "c", "empty"], f"{tmp_path}/out", f"{tmp_path}/mark"
    sizes = []
    for turn in range(6):  # a run takes what one walk finds, so each begins where the one before was stopped
        query = stream(spark, playlists).writeStream.foreachBatch(runs.once(out, "r")).option("checkpointLocation", mark).trigger(once=True).start()
        query.awaitTermination()
        sizes.append(runs.committed(spark, out, listings.ITEMS).count())
    got = sorted(((r.playlist_id, r.page_no, r.at, r.video_id, r.error) for r in runs.committed(spark, out, listings.ITEMS).collect()), key=repr)
    assert got == wanted(playlists)
    assert sizes[0] < sizes[1] < sizes[-1] == sizes[-2]
    order = [r.video_id for r in listings.numbered(runs.committed(spark, out, listings.ITEMS)).where("playlist_id = 'a'").orderBy("video_index").collect()]
    assert order == [v for p, _, _, v, _ in sorted(wanted(["a"]), key=lambda r: (r[1], r[2]))]


def test_captions_of_items_with_errors(spark):
    class Down(Exception):
        pass

    def caption(video):
        if video.endswith("9"):
            raise Down
        return None if video.endswith("8") else {"language_code": "pt", "raw_text": f"text of {video}"}

    rows = spark.createDataFrame([(f"video-{k:03}", "x") for k in range(30)] + [("short", "x"), (None, "x")], "video_id string, error_type string")
    got = {r.video_id: r for r in listings.fetched_captions(rows, caption, window=4).collect()}
    assert len(got) == 32 and got["video-003"].raw_text == "text of video-003" and got["video-003"].success and got["video-003"].error_type is None
    assert {got[k].error_type for k in ("short", None)} == {"invalid_video_id"}
    assert got["video-008"].error_type == "no_transcript" and got["video-019"].error_type == "api_error" and not got["video-019"].success
